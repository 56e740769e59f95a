"""Swing nodes with a smallest move, and five-point ratio patterns between them with their fates, as rows.

Pivots come from window expressions. One fold for each series runs over the narrow table of pivots only; patterns are `lag` on
the narrower table of nodes against a table of ratios, and fates an equi-join with blocks of bars, bounded by later nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bars of a block: what a pattern's later bars are looked up by.
SPAN = 256

#: Name, then lowest and highest share of B on XA, C on AB, D on XA, and CD on BC.
HARMONIC_RATIOS = (
    ("gartley", 0.586, 0.65, 0.382, 0.886, 0.75, 0.82, 1.13, 1.618),
    ("bat", 0.382, 0.5, 0.382, 0.886, 0.85, 0.92, 1.618, 2.618),
    ("butterfly", 0.75, 0.82, 0.382, 0.886, 1.13, 1.618, 1.618, 2.618),
    ("crab", 0.382, 0.618, 0.382, 0.886, 1.5, 1.7, 2.24, 3.618),
    ("deep_crab", 0.85, 0.92, 0.382, 0.886, 1.5, 1.7, 2.24, 3.618),
    ("shark", 0.382, 0.618, 1.13, 1.618, 0.85, 1.13, 1.618, 2.24),
)
_NODES = "series string, nth long, side int, price double, at long, node_ts timestamp_ntz, found_at long, found_ts timestamp_ntz"


def numbered(bars: DataFrame) -> DataFrame:
    """(series, i, ts, high, low, close) with i from 1."""
    return bars.select("series", F.row_number().over(Window.partitionBy("series").orderBy("ts")).cast("long").alias("i"), "ts", "high", "low", "close")


def node_pivots(bars: DataFrame, depth: int = 3, atr: str | None = None) -> DataFrame:
    """(series, at, node_ts, found_at, found_ts, high, low, atr): bars whose high (low) no other within `depth` exceeds, ties
    allowed; the price of the other side is null."""
    w = Window.partitionBy("series").orderBy("ts")
    whole = w.rowsBetween(-2 * depth, 0)
    pick = lambda c, best: F.when(F.lag(c, depth).over(w) == best(c).over(whole), F.lag(c, depth).over(w))
    rows = bars.select("series", F.col("ts").alias("found_ts"), F.row_number().over(w).cast("long").alias("found_at"), F.lag("ts", depth).over(w).alias("node_ts"), pick("high", F.max).alias("high"), pick("low", F.min).alias("low"), (F.col(atr) if atr else F.lit(None)).cast("double").alias("atr"))
    return rows.filter((F.col("found_at") > 2 * depth) & (F.col("high").isNotNull() | F.col("low").isNotNull())).withColumn("at", F.col("found_at") - depth)


def _fold(pivots: pd.DataFrame, backstep: int, move: float, by_atr: bool) -> Iterator[tuple]:
    """The fixed nodes of one series: (side, price, at, node_ts, found_at, found_ts)."""
    side, price, place, turned = 0, 0.0, None, None
    for p in pivots.sort_values("at").itertuples():
        tops = {s: sign for s, sign in ((1, p.high), (-1, p.low)) if sign == sign}
        if side == 0:
            if len(tops) == 1:
                (side, price), place = next(iter(tops.items())), (p.at, p.node_ts)
            continue
        free = turned is None or p.at >= turned + backstep
        if side in tops and side * (tops[side] - price) > 0:
            price, place = tops[side], (p.at, p.node_ts)
        if -side not in tops:
            continue
        gain = side * (price - tops[-side])
        far = gain >= move * p.atr if by_atr else price != 0 and gain / abs(price) >= move / 100
        if free and gain > 0 and far:
            yield side, price, *place, p.found_at, p.found_ts
            side, price, place, turned = -side, tops[-side], (p.at, p.node_ts), p.at


def swing_nodes(bars: DataFrame, depth: int = 3, backstep: int = 2, deviation: float = 1.0, atr: str | None = None) -> DataFrame:
    """(series, nth, side, price, at, node_ts, found_at, found_ts): nodes that a later turn has fixed, side 1 for highs.

    A pivot of the running node's side moves it if more extreme. One of the other side that lies beyond it by `deviation`
    percent (of `atr`, a column of `bars`: multiples of it, none while it is null), at least `backstep` bars after the last
    pivot that did so, fixes the running node and runs on itself. A bar that is both serves the running side first, and starts
    nothing. `found_at` is the bar on which a node is fixed. A series' pivots must fit a task, its bars need not.
    """

    def fold(pivots: pd.DataFrame) -> pd.DataFrame:
        series = pivots["series"].iloc[0]
        rows = [(series, n, *node) for n, node in enumerate(_fold(pivots, backstep, deviation, atr is not None), 1)]
        return pd.DataFrame(rows, columns=["series", "nth", "side", "price", "at", "node_ts", "found_at", "found_ts"])

    return node_pivots(bars, depth, atr).groupBy("series").applyInPandas(fold, _NODES)


def _zone(d: Column, cd: Column, least: float) -> Column:
    """Where three projections of D lie: by XA, by BC, and by AB as long as CD; never narrower than `least` of XA."""
    x, a, b, c = (F.col(p) for p in "xabc")
    ends = (a - d * (a - x), c - cd * (c - b), c + (b - a))
    low, high, floor = F.least(*ends), F.greatest(*ends), least * F.abs(a - x)
    thin, middle = high - low < floor, (high + low) / 2
    return F.struct(F.when(thin, middle - floor / 2).otherwise(low).alias("low"), F.when(thin, middle + floor / 2).otherwise(high).alias("high"))


def harmonic_structures(nodes: DataFrame, complete: bool = True, tolerance: float = 0.03, least_zone: float = 0.005, pending: int = 2) -> DataFrame:
    """Patterns of nodes X, A, B, C and, if `complete`, D: one row for each fitting row of HARMONIC_RATIOS, each interval
    widened by `tolerance`. bullish: X is a low. `last_at` is the last node's bar, `until` the bar on which the node that ends
    the wait is fixed: `pending` nodes may follow, null means not yet."""
    w = Window.partitionBy("series").orderBy("nth")
    points = "xabcd" if complete else "xabc"
    back = {p: len(points) - 1 - k for k, p in enumerate(points)}
    lagged = [F.lag("price", k).over(w).alias(p) if k else F.col("price").alias(p) for p, k in back.items()]
    rows = nodes.select("series", F.lag("node_ts", back["x"]).over(w).alias("x_ts"), F.col("node_ts").alias("last_ts"), F.col("at").alias("last_at"), "found_at", "found_ts", F.lead("found_at", pending + 1).over(w).alias("until"), (F.col("side") * (-1) ** back["x"] < 0).alias("bullish"), *lagged).filter("x IS NOT NULL")
    leg = lambda p, q: F.abs(F.col(q) - F.col(p))
    shares = {"b": leg("a", "b") / leg("x", "a"), "c": leg("b", "c") / leg("a", "b")} | ({"d": leg("a", "d") / leg("x", "a"), "cd": leg("c", "d") / leg("b", "c")} if complete else {})
    rows = rows.filter((leg("x", "a") > 2.0**-52) & (leg("a", "b") > 2.0**-52) & (leg("b", "c") > 2.0**-52)).withColumns({f"{n}_share": s for n, s in shares.items()})
    names = ("name", *(f"{p}_{e}" for p in ("b", "c", "d", "cd") for e in ("min", "max")))
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in HARMONIC_RATIOS])
    fitted = rows.withColumn("r", F.explode(table))
    for n in shares:
        fitted = fitted.filter((F.col(f"{n}_share") >= F.col(f"r.{n}_min") - tolerance) & (F.col(f"{n}_share") <= F.col(f"r.{n}_max") + tolerance))
    middle = lambda n: (F.col(f"r.{n}_min") + F.col(f"r.{n}_max")) / 2
    zone = _zone(middle("d"), middle("cd"), least_zone)
    return fitted.withColumn("z", zone).select("series", F.col("r.name").alias("pattern"), "bullish", *rows.columns[1:7], *points, *[f"{n}_share" for n in shares], F.col("z.low").alias("zone_low"), F.col("z.high").alias("zone_high"))


def with_fate(found: DataFrame, bars: DataFrame, complete: bool = True) -> DataFrame:
    """`found` with state, reached_ts and decided_ts.

    A pattern without D is a candidate until a bar reaches its zone; that makes it complete. From then on a close beyond the
    zone against its direction makes it invalidated (on the reaching bar already), one beyond it the other way confirmed (later
    bars only). `until` ends the wait: dropped. What was decided before the last node was fixed counts from then on.
    """
    key = ["series", "pattern", "last_at"]
    rows = numbered(bars).withColumn("block", F.floor(F.col("i") / SPAN))
    ends = rows.groupBy("series").agg(F.max("i").alias("end"))
    spread = found.join(ends, "series").withColumn("stop", F.coalesce("until", "end"))
    blocks = F.sequence(F.floor((F.col("last_at") + 1) / SPAN), F.floor(F.greatest(F.col("last_at") + 1, F.col("stop")) / SPAN))
    met = spread.select(*key, "stop", "bullish", "zone_low", "zone_high", F.explode(blocks).alias("block")).join(rows, ["series", "block"]).filter((F.col("i") > F.col("last_at")) & (F.col("i") <= F.col("stop")))
    up, low, high, close = F.col("bullish"), F.col("zone_low"), F.col("zone_high"), F.col("close")
    against, turn = F.when(up, close < low).otherwise(close > high), F.when(up, close > high).otherwise(close < low)
    if complete:
        met = met.filter(against | turn).withColumn("reached", F.col("last_at"))
    else:
        inside = F.when(up, F.col("low") <= high).otherwise(F.col("high") >= low)
        met = met.withColumn("reached", F.min(F.when(inside, F.col("i"))).over(Window.partitionBy(*key))).filter("reached IS NOT NULL")
    decisive = (against & (F.col("i") >= F.col("reached"))) | (turn & (F.col("i") > F.col("reached")))
    told = F.struct("i", "ts", turn.alias("turned"))
    fate = met.groupBy(*key).agg(F.min(F.when(decisive, told)).alias("fate"), F.min(F.when(F.col("i") == F.col("reached"), F.col("ts"))).alias("reached_ts"))
    out = found.join(fate, key, "left")
    known = F.col("reached_ts").isNotNull() if not complete else F.lit(True)
    state = F.when(F.col("fate.turned"), "confirmed").when(~F.col("fate.turned"), "invalidated").when(F.col("until").isNotNull(), "dropped").when(known, "complete").otherwise("candidate")
    reached = F.col("last_ts") if complete else F.col("reached_ts")
    return out.select(*found.columns, state.alias("state"), reached.alias("reached_ts"), F.greatest(F.col("fate.ts"), F.when(F.col("fate").isNotNull(), F.col("found_ts"))).alias("decided_ts"))


def harmonic_patterns(bars: DataFrame, depth: int = 3, backstep: int = 2, deviation: float = 1.0, atr: str | None = None, complete: bool = True, tolerance: float = 0.03, least_zone: float = 0.005, pending: int = 2) -> DataFrame:
    """harmonic_structures over the bars' swing nodes, with their fates."""
    return with_fate(harmonic_structures(swing_nodes(bars, depth, backstep, deviation, atr), complete, tolerance, least_zone, pending), bars, complete)
