"""Legs of price as window expressions: the last leg of a window, what is given back of it, paths and swing sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.swings import pivots

def _order():
    return Window.partitionBy("series").orderBy("ts")


def retracement(start: Column, end: Column, price: Column, deep: float = 0.618) -> tuple[Column, Column]:
    """Share of a leg that the price has given back, and its zone; null for a leg without size."""
    share = F.when(end != start, (end - price) / (end - start))
    zone = F.when(share < 0, "extension").when(share < deep, "correction").when(share <= 1, "deep_correction").when(share > 1, "reversal")
    return share, zone


def window_legs(bars: DataFrame, length: int, deep: float = 0.618) -> DataFrame:
    """For each bar with `length` bars behind it (itself included): the leg between the window's extremes, and the close's place.

    The lowest low is the earliest of equal ones, the highest high the latest; the earlier of the two starts the leg.
    """
    last = _order().rowsBetween(1 - length, 0)
    found = bars.withColumn("i", F.row_number().over(_order())).withColumns({"lo": F.min(F.struct("low", "i")).over(last), "hi": F.max(F.struct("high", "i")).over(last)}).filter(F.col("i") >= length)
    up = F.col("hi.i") > F.col("lo.i")
    legs = found.withColumns({"up": up, "leg_start": F.when(up, F.col("lo.low")).otherwise(F.col("hi.high")), "leg_end": F.when(up, F.col("hi.high")).otherwise(F.col("lo.low")), "leg_bars": F.abs(F.col("hi.i") - F.col("lo.i")).cast("long")})
    share, zone = retracement(F.col("leg_start"), F.col("leg_end"), F.col("close"), deep)
    return legs.select("series", "ts", "up", "leg_start", "leg_end", "leg_bars", share.alias("share"), zone.alias("zone"))


def path_efficiency(bars: DataFrame, points: int) -> DataFrame:
    """Net move by travel over the last `points` closes: 1 for a straight run, 0 where nothing moved."""
    last = _order().rowsBetween(2 - points, 0)
    moves = bars.withColumns({"move": F.abs(F.col("close") - F.lag("close").over(_order())), "net": F.abs(F.col("close") - F.lag("close", points - 1).over(_order()))}).withColumn("path", F.sum("move").over(last))
    return moves.filter("net is not null").select("series", "ts", F.when(F.col("path") > 0, F.col("net") / F.col("path")).otherwise(0.0).alias("efficiency"))


def swing_sequences(bars: DataFrame, width: int) -> DataFrame:
    """Whether the last two confirmed swing highs and lows both rise (up), both fall (down), neither (mixed), or lack (unknown)."""
    so_far, before = _order().rowsBetween(Window.unboundedPreceding, 0), _order().rowsBetween(Window.unboundedPreceding, -1)
    marked = bars.withColumn("i", F.row_number().over(_order()))
    marked = marked.withColumns({k: F.expr(e) for k, e in pivots(width, width, True).items()})
    steps = marked.withColumns({f"{p}_step": F.when(F.col(p).isNotNull(), F.signum(F.col(p) - F.last(p, ignorenulls=True).over(before))) for p in ("ph", "pl")})
    ends = steps.withColumns({f"{p}_now": F.last(f"{p}_step", ignorenulls=True).over(so_far) for p in ("ph", "pl")})
    high, low = F.col("ph_now"), F.col("pl_now")
    sequence = F.when(high.isNull() | low.isNull(), "unknown").when((high > 0) & (low > 0), "up").when((high < 0) & (low < 0), "down").otherwise("mixed")
    return ends.select("series", "ts", "ph", "pl", sequence.alias("sequence"))
