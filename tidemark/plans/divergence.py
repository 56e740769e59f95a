"""Divergences of price and an oscillator between pivots, as rows.

Pivots are found by window expressions, pairs by `lag` on the narrow table of pivots, so nothing is joined to itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import oscillators, recursive  # noqa: F401  their operators register themselves
from ..operators.spec import apply, build

OSCILLATORS = ("rsi", "wavetrend", "stoch_rsi", "williams_r", "cci")
#: Their values count to so many digits, so that equal ones tie whatever the last bits of sums in another order.
DIGITS = 9


def with_oscillator(bars: DataFrame, name: str = "rsi") -> DataFrame:
    """(series, ts, high, low, osc): the value of one of OSCILLATORS with its usual parameters, to DIGITS digits."""
    if name not in OSCILLATORS:
        raise ValueError(f"oscillator must be one of {OSCILLATORS}")
    return apply(bars, [build(name)], ["series", "ts", "high", "low"]).select("series", "ts", "high", "low", F.round("value", DIGITS).alias("osc"))


def quality(before: Column, now: Column, osc_before: Column, osc: Column, between: Column, least: int, most: int) -> Column:
    """0 to 1: six tenths for how far both lines moved, four tenths for a distance near the middle of what is allowed."""
    move = lambda a, b: F.abs(b - a) / F.greatest(F.abs(a), F.lit(1e-9))
    size = F.least((move(before, now) + move(osc_before, osc)) / 2, F.lit(1.0))
    span = max(most - least, 1)
    near = 1 - F.least(F.abs(between - (least + span / 2)) / max(span / 2, 1.0), F.lit(1.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * size + 0.4 * near))


def divergences(rows: DataFrame, left: int = 7, right: int = 7, min_distance: int = 10, max_distance: int = 120, max_prior: int = 5, source: str = "price", anchor: str = "pivot") -> DataFrame:
    """Events of rows (series, ts, high, low, osc): one for each pivot that diverges from an earlier one of its side.

    A pivot tops (undercuts) all bars from `left` before to `right` after, strictly, and is known `right` bars later; `source`
    says on which line, `price` or `oscillator`. Of its last `max_prior` predecessors at an allowed distance, the pair of the
    best quality counts, the nearer one on a tie. regular_bullish: a lower low in price, a higher one in the oscillator;
    hidden_bullish: the reverse; bearish ones likewise at highs. `anchor` says which oscillator value stands for a pivot of
    prices: the pivot's own, or the `extreme` of its window. Bars without an oscillator do not count as bars.
    """
    w = Window.partitionBy("series").orderBy("ts")
    live = rows.filter("osc IS NOT NULL").withColumn("i", F.row_number().over(w))
    found = []
    for side, price, best, sign in (("low", "low", F.min, -1), ("high", "high", F.max, 1)):
        line = price if source == "price" else "osc"
        there = F.lag(line, right).over(w)
        tops = lambda a, b, line=line, best=best, sign=sign, there=there: sign * there > sign * best(line).over(w.rowsBetween(a, b))
        strict = (F.col("i") > left + right) & tops(-left - right, -right - 1) & tops(-right + 1, 0)
        extreme = source == "price" and anchor == "extreme"
        osc = best("osc").over(w.rowsBetween(-left - right, 0)) if extreme else F.lag("osc", right).over(w)
        nodes = live.select("series", F.col("ts").alias("confirmed_ts"), F.lag("ts", right).over(w).alias("pivot_ts"), (F.col("i") - right).alias("at"), F.lag(price, right).over(w).alias("price"), osc.alias("osc"), strict.alias("strict")).filter("strict")
        order = Window.partitionBy("series").orderBy("at")
        pairs = []
        for k in range(1, max_prior + 1):
            then = {c: F.lag(c, k).over(order) for c in ("at", "price", "osc", "pivot_ts")}
            between = F.col("at") - then["at"]
            up, osc_up = F.signum(F.col("price") - then["price"]), F.signum(F.col("osc") - then["osc"])
            kind = F.when(up * osc_up < 0, F.when(up == sign, "regular").otherwise("hidden"))
            score = quality(then["price"], F.col("price"), then["osc"], F.col("osc"), between, min_distance, max_distance)
            fine = kind.isNotNull() & between.between(min_distance, max_distance)
            pairs.append(F.when(fine, F.struct(score.alias("quality"), F.lit(-k).alias("nearness"), kind.alias("kind"), then["pivot_ts"].alias("previous_ts"), then["price"].alias("previous_price"), then["osc"].alias("previous_osc"), between.alias("bars_between"))))
        chosen = nodes.withColumn("best", F.array_max(F.array_compact(F.array(*pairs)))).filter("best IS NOT NULL")
        tone = "bullish" if side == "low" else "bearish"
        found.append(chosen.select(
            "series", F.concat_ws("_", F.col("best.kind"), F.lit(tone)).alias("kind"), F.col("best.previous_ts").alias("previous_ts"), "pivot_ts", "confirmed_ts", F.col("best.previous_price").alias("previous_price"), F.col("price").alias("pivot_price"),
            F.col("best.previous_osc").alias("previous_osc"), F.col("osc").alias("pivot_osc"), F.col("best.bars_between").cast("long").alias("bars_between"), F.col("best.quality").alias("quality"),
        ))
    return found[0].union(found[1])


def divergence_bars(bars: DataFrame, oscillator: str = "rsi", right: int = 7, **params) -> DataFrame:
    """Each bar's oscillator value with the event it confirms: direction 1 or -1, hidden or not, prices, distance, quality.
    A bar that confirms two events shows the bearish one."""
    rows = with_oscillator(bars, oscillator)
    events = divergences(rows, right=right, **params)
    bearish = F.col("kind").endswith("bearish").cast("int")
    last = events.groupBy("series", F.col("confirmed_ts").alias("ts")).agg(F.max_by(F.struct("kind", "pivot_price", "previous_price", "bars_between", "quality"), bearish).alias("e"))
    e = lambda c: F.col(f"e.{c}")
    joined = rows.join(last, ["series", "ts"], "left")
    return joined.select("series", "ts", F.col("osc").alias("value"), F.when(e("kind").endswith("bullish"), 1).when(e("kind").isNotNull(), -1).alias("direction"), e("kind").startswith("hidden").alias("hidden"), e("pivot_price").alias("pivot_price"), e("previous_price").alias("previous_price"), F.when(e("kind").isNotNull(), right).alias("pivot_age"), e("bars_between").alias("bars_between"), e("quality").alias("quality"))
