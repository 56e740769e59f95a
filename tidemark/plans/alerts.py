"""Alerts as event rows with identities that a rerun repeats.

A rule is (kind, condition, strength), expressions over a row of outputs. All rules of a table are tried in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PHASES = ("setup", "watch", "trigger", "invalidation", "expiry", "target_hit")

#: Rules on the outputs of operators and plans, by the table they are for.
RULES: dict[str, list[tuple[str, str, str]]] = {
    "zone_rejection": [("bull_failed_breakout", "value = 1", "strength"), ("bear_failed_breakout", "value = -1", "strength")],
    "order_block": [
        ("bullish_order_block", "born_bullish > 0", "0.9D"), ("bearish_order_block", "born_bearish > 0", "0.9D"),
        ("ob_retest_bullish", "retest_bullish > 0", "0.8D"), ("ob_retest_bearish", "retest_bearish > 0", "0.8D"),
    ],
    "divergence": [
        ("bull_divergence", "direction = 1 AND NOT hidden", "quality"), ("bear_divergence", "direction = -1 AND NOT hidden", "quality"),
        ("bull_hidden_divergence", "direction = 1 AND hidden", "quality"), ("bear_hidden_divergence", "direction = -1 AND hidden", "quality"),
    ],
    "point_and_figure": [("pnf_new_x_column", "opened = 1 AND value = 1", "1.0D"), ("pnf_new_o_column", "opened = 1 AND value = -1", "1.0D")],
}


def event_id(series: Column, timeframe: str, kind: Column, phase: str, ts: Column) -> Column:
    """Instrument, timeframe, kind and phase, each after its length in bytes, and the Unix time; equal events, equal ids."""
    parts = [F.coalesce(series, F.lit("")), F.lit(timeframe), kind, F.lit(phase)]
    return F.concat_ws(":", *[F.concat(F.octet_length(p).cast("string"), F.lit("#"), p) for p in parts], F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts).cast("string"))


def events(rows: DataFrame, rules: list[tuple[str, str, str]], source: str, timeframe: str = "", phase: str = "trigger") -> DataFrame:
    """(event_id, series, ts, source, timeframe, kind, phase, strength): a row for each bar and rule that holds there."""
    if phase not in PHASES:
        raise ValueError(f"phase must be one of {PHASES}")
    found = F.array_compact(F.array(*[F.when(F.expr(condition), F.struct(F.lit(kind).alias("kind"), F.expr(strength).cast("double").alias("strength"))) for kind, condition, strength in rules]))
    each = rows.select("series", "ts", F.explode(found).alias("e"))
    return each.select(event_id(F.col("series"), timeframe, F.col("e.kind"), phase, F.col("ts")).alias("event_id"), "series", "ts", F.lit(source).alias("source"), F.lit(timeframe).alias("timeframe"), F.col("e.kind").alias("kind"), F.lit(phase).alias("phase"), F.col("e.strength").alias("strength"))


def unique(found: DataFrame) -> DataFrame:
    """One row for each identity."""
    return found.dropDuplicates(["event_id"])
