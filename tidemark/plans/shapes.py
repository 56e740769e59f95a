"""Chart shapes between swing nodes: lines through three to five nodes, how well they fit, and what later closes make of them.

A shape is one row with two lines, `up` and `down`, as (at, price, slope a second). A later close beyond one of them decides:
`bias` 1 (-1) means that `up` (`down`) confirms and the other one invalidates, 0 that either confirms. `goal`, a third line,
is where a confirming close may not go beyond. Nodes come from patterns.swing_nodes, highs and lows in turn.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .patterns import SPAN, numbered, swing_nodes

#: How far a flag's channel may narrow or widen, as a share of its width, and the most it gives back of its pole.
FLAG_PARALLEL = 0.25
FLAG_RETRACE = 0.5

_seconds = lambda ts: F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def _line(i: int, j: int) -> Column:
    """Through the nodes i and j places back."""
    t, p = (lambda k: F.col(f"t{k}")), (lambda k: F.col(f"p{k}"))
    return F.struct(t(i).alias("at"), p(i).alias("price"), ((p(j) - p(i)) / (t(j) - t(i))).alias("slope"))


def _level(k: int | Column) -> Column:
    """A level line, through node k or at a price."""
    return F.struct(F.col("t0").alias("at"), (F.col(f"p{k}") if isinstance(k, int) else k).alias("price"), F.lit(0.0).alias("slope"))


def value_at(line: Column, seconds: Column) -> Column:
    """A line's price at a Unix time."""
    return line["price"] + line["slope"] * (seconds - line["at"])


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _shape(nodes: int, kind: Column, holds: Column, fit: Column, bias: Column, up: Column, down: Column, goal: Column | None = None) -> Column:
    """NULL unless `holds` and `kind` is known."""
    none = F.lit(None).cast("struct<at:double,price:double,slope:double>")
    made = F.struct(kind.alias("kind"), F.lit(nodes).alias("nodes"), fit.alias("fit"), bias.cast("int").alias("bias"), up.alias("up"), down.alias("down"), (goal if goal is not None else none).alias("goal"))
    return F.when((F.col("nth") >= nodes) & holds & kind.isNotNull(), made)


def _channels(flat: float) -> Column:
    """Four nodes, a line through the highs and one through the lows: triangles, wedges, broadening formations."""
    last_high = F.col("side") > 0
    upper, lower = F.when(last_high, _line(2, 0)).otherwise(_line(3, 1)), F.when(last_high, _line(3, 1)).otherwise(_line(2, 0))
    width = lambda k: value_at(upper, F.col(k)) - value_at(lower, F.col(k))
    opened, closed = width("t3"), width("t0")
    rise, sink = upper["slope"], lower["slope"]
    level = lambda line: F.abs(value_at(line, F.col("t0")) - value_at(line, F.col("t3"))) / F.greatest(opened, F.lit(1e-9)) < flat / 100
    wider = F.when(~level(upper) & ~level(lower) & (rise > 0) & (sink < 0), "broadening")
    narrower = (
        F.when((rise > 0) & (sink > 0), "rising_wedge").when((rise < 0) & (sink < 0), "falling_wedge").when(level(upper) & (sink > 0), "ascending_triangle")
        .when(level(lower) & (rise < 0), "descending_triangle").when((rise <= 0) & (sink >= 0), "triangle")
    )
    kind = F.when(closed > opened, wider).when(closed < opened, narrower)
    return _shape(4, kind, (opened > 0) & (closed > 0), _clamp(1 - F.least(opened, closed) / F.greatest(opened, closed)), F.lit(0), upper, lower)


def chart_shapes(nodes: DataFrame, tolerance: float = 2.0, flat: float = 1.5, pending: int = 2) -> DataFrame:
    """(series, first_nth, last_nth, first_ts, last_ts, last_at, found_at, found_ts, until, kind, nodes, fit, bias, up, down, goal):
    every shape whose last node a row is, before any choice among overlapping ones.

    Prices within `tolerance` percent are one level, a line that moves less than `flat` percent of its channel's width is level.
    fit (0 to 1): how equal the levels are, how much a channel narrows or widens, how parallel a flag is, how far a 1-2-3 goes.
    `until`: the bar on which the node that ends the wait is fixed: `pending` nodes may follow; null: not yet.
    """
    w = Window.partitionBy("series").orderBy("nth")
    back = lambda c, k: F.lag(c, k).over(w) if k else F.col(c)
    rows = nodes.withColumn("seconds", _seconds("node_ts")).select(
        "series", F.col("nth").cast("long").alias("nth"), "side", "at", "found_at", "found_ts", F.lead("found_at", pending + 1).over(w).alias("until"),
        *[back("price", k).alias(f"p{k}") for k in range(5)], *[back("seconds", k).alias(f"t{k}") for k in range(5)], F.array(*[back("node_ts", k) for k in range(5)]).alias("stamps"),
    )
    p0, p1, p2, p3, p4 = (F.col(f"p{k}") for k in range(5))
    t0, t1, t3 = F.col("t0"), F.col("t1"), F.col("t3")
    side = F.col("side")
    top = side > 0
    most = lambda *c: F.when(top, F.greatest(*c)).otherwise(F.least(*c))
    allowed = lambda scale: tolerance / 100 * F.greatest(F.abs(scale), F.lit(1e-9))
    same = lambda a, b, scale: F.abs(a - b) <= allowed(scale)
    match = lambda a, b, scale: _clamp(1 - F.abs(a - b) / allowed(scale))
    named = lambda high, low, when=top: F.when(when, high).otherwise(low)

    def sided(bias: Column, with_it: Column, against: Column) -> tuple[Column, Column, Column]:
        """bias, up, down: `with_it` lies on the side of the bias."""
        return bias, F.when(bias > 0, with_it).otherwise(against), F.when(bias > 0, against).otherwise(with_it)

    def reversal(count: int, high: str, low: str, holds: Column, fit: Column, neck: Column) -> Column:
        """Tops fall through the neckline, bottoms rise through it; beyond their own extreme they are void."""
        extreme = _level(most(*[F.col(f"p{k}") for k in range(count)]))
        return _shape(count, named(high, low), holds, fit, *sided(-side, neck, extreme))

    bull = -side  # direction of shapes that end on a node against it
    across, along = _line(4, 2), _line(3, 1)  # of five nodes: through the first and third, the second and fourth
    apart = lambda k: bull * (value_at(along, F.col(k)) - value_at(across, F.col(k)))
    wolfe = (bull * (p2 - p4) < 0) & (bull * (p1 - p4) > 0) & (bull * (p1 - p3) < 0) & (bull * (along["slope"] - across["slope"]) < 0) & (bull * (p0 - value_at(across, t0)) < 0)
    far = _line(2, 0)
    channel = lambda k: bull * (value_at(along, F.col(k)) - value_at(far, F.col(k)))
    bent = F.abs(channel("t0") - channel("t3")) / channel("t3")
    flag = (
        (bull * (p1 - p3) < 0) & (bull * (p0 - p2) < 0) & (channel("t3") > 0) & (channel("t0") > 0) & (bent <= FLAG_PARALLEL)
        & (bull * (p3 - F.when(bull > 0, F.least(p0, p2)).otherwise(F.greatest(p0, p2))) <= FLAG_RETRACE * bull * (p3 - p4))
    )
    cup = same(p3, p1, p3) & ~same(p3, p2, p3) & (bull * (p0 - (p1 + p2) / 2) >= 0) & (2 * (t0 - t1) <= t1 - t3)
    shapes = [
        _channels(flat),
        _shape(3, F.lit("reversal_123"), side * (p0 - p2) > 0, F.least(F.abs(p0 - p2) / F.greatest(F.abs(p2), F.lit(1e-9)), F.lit(1.0)), *sided(side, _level(0), _level(1))),
        reversal(3, "double_top", "double_bottom", same(p2, p0, p2) & ~same(p2, p1, p2), match(p2, p0, p2), _level(1)),
        reversal(5, "triple_top", "triple_bottom", same(p4, p2, p4) & same(p4, p0, p4) & ~same(p4, p3, p4), match(p4, p2, p4) * match(p4, p0, p4), _level(F.when(top, F.least(p1, p3)).otherwise(F.greatest(p1, p3)))),
        reversal(5, "head_and_shoulders", "inverse_head_and_shoulders", (side * (p2 - p4) > 0) & (side * (p2 - p0) > 0) & same(p4, p0, p2) & same(p3, p1, p2), match(p4, p0, p2) * match(p3, p1, p2), _line(3, 1)),
        _shape(5, F.lit("wolfe_wave"), wolfe, _clamp(1 - apart("t0") / F.greatest(apart("t4"), F.lit(1e-9))), bull, _level(0), _level(0), _line(4, 1)),
        _shape(5, F.lit("flag"), flag, _clamp(1 - bent / FLAG_PARALLEL), *sided(bull, along, far)),
        _shape(4, named("cup_and_handle", "inverse_cup_and_handle", bull > 0), cup, match(p3, p1, p3), *sided(bull, _level(1), _level(0))),
    ]
    each = rows.filter("nth >= 3").withColumn("s", F.explode(F.array_compact(F.array(*shapes))))
    return each.select(
        "series", (F.col("nth") - F.col("s.nodes") + 1).alias("first_nth"), F.col("nth").alias("last_nth"), F.get("stamps", F.col("s.nodes") - 1).alias("first_ts"), F.get("stamps", F.lit(0)).alias("last_ts"),
        F.col("at").alias("last_at"), "found_at", "found_ts", "until", "s.*",
    )


def with_outcome(found: DataFrame, bars: DataFrame) -> DataFrame:
    """`found` with state, bullish, level, goal_price and decided_ts, by the first close after the last node that decides.

    state: forming, confirmed, invalidated, or dropped (`until` came first). bullish: the confirming close's direction, else the
    bias's (null for 0). level: the confirming line at that close. What was decided before the last node was fixed counts from then on.
    """
    key = ["series", "kind", "last_nth"]
    rows = numbered(bars).select("series", "i", "ts", "close").withColumn("block", F.floor(F.col("i") / SPAN))
    ends = rows.groupBy("series").agg(F.max("i").alias("end"))
    spread = found.select(*key, "last_at", "until", "bias", "up", "down", "goal").join(ends, "series").withColumn("stop", F.coalesce("until", "end"))
    blocks = F.sequence(F.floor((F.col("last_at") + 1) / SPAN), F.floor(F.greatest(F.col("last_at") + 1, F.col("stop")) / SPAN))
    met = spread.withColumn("block", F.explode(blocks)).join(rows, ["series", "block"]).filter((F.col("i") > F.col("last_at")) & (F.col("i") <= F.col("stop")))
    now, close, bias = _seconds("ts"), F.col("close"), F.col("bias")
    up, down, goal = (value_at(F.col(c), now) for c in ("up", "down", "goal"))
    rises = (close > up) & F.coalesce(close <= goal, F.lit(True))
    falls = (close < down) & F.coalesce(close >= goal, F.lit(True))
    won = ((bias >= 0) & rises) | ((bias <= 0) & falls)
    lost = ((bias > 0) & (close < down)) | ((bias < 0) & (close > up))
    risen = (bias > 0) | ((bias == 0) & rises)
    told = F.struct("i", "ts", won.alias("won"), F.when(won, risen).alias("bullish"), F.when(won, F.when(risen, up).otherwise(down)).alias("level"), F.when(won, goal).alias("goal_price"))
    fate = met.filter(won | lost).groupBy(*key).agg(F.min(told).alias("fate"))
    state = F.when(F.col("fate.won"), "confirmed").when(~F.col("fate.won"), "invalidated").when(F.col("until").isNotNull(), "dropped").otherwise("forming")
    return found.join(fate, key, "left").select(
        *found.columns, state.alias("state"), F.coalesce("fate.bullish", F.when(F.col("bias") != 0, F.col("bias") > 0)).alias("bullish"), "fate.level", "fate.goal_price",
        F.when(F.col("fate").isNotNull(), F.greatest("fate.ts", "found_ts")).alias("decided_ts"),
    )


def best_apart(found: DataFrame) -> DataFrame:
    """`found` without shapes that share a node with a better one of their kind that stays (greedy by fit, then the earlier).

    Shapes are first cut into islands that share no node, so a task holds one island's three narrow columns, not a series.
    """
    order = Window.partitionBy("series", "kind").orderBy("last_nth")
    reach = F.max("last_nth").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = found.select("series", "kind", "first_nth", "last_nth", "fit", F.coalesce(F.col("first_nth") > reach, F.lit(True)).cast("long").alias("opens"))
    parts = parts.withColumn("island", F.sum("opens").over(order))

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        starts, ends = [], []  # of what stays, ascending and apart
        for row in part.sort_values(["fit", "last_nth"], ascending=[False, True]).itertuples():
            k = bisect_left(ends, row.first_nth)
            if k == len(ends) or starts[k] > row.last_nth:
                starts.insert(k, row.first_nth)
                ends.insert(k, row.last_nth)
        return pd.DataFrame({"series": part["series"].iloc[0], "kind": part["kind"].iloc[0], "last_nth": ends})

    kept = parts.groupBy("series", "kind", "island").applyInPandas(choose, "series string, kind string, last_nth long")
    return found.join(kept, ["series", "kind", "last_nth"], "left_semi")


def fitted_lines(nodes: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """(series, side, first_ts, first_price, last_ts, last_price, slope, touches, fit): for each series the line from the first to the
    last high (low), if no other high (low) lies over (under) it by more than `tolerance` percent. slope: price a second."""
    end = lambda best: best(F.struct("node_ts", "price"), "nth")
    ends = nodes.groupBy("series", "side").agg(end(F.min_by).alias("first"), end(F.max_by).alias("last"), F.count(F.lit(1)).alias("touches")).filter("touches > 1")
    begun = _seconds("first.node_ts")
    line = ends.withColumn("slope", (F.col("last.price") - F.col("first.price")) / (_seconds("last.node_ts") - begun))
    on = F.col("first.price") + F.col("slope") * (_seconds("node_ts") - begun)
    beyond = F.when(F.col("side") > 0, F.col("price") > on * (1 + tolerance / 100)).otherwise(F.col("price") < on * (1 - tolerance / 100))
    pierced = nodes.select("series", "side", "node_ts", "price").join(line, ["series", "side"]).filter(beyond).select("series", "side").distinct()
    fit = _clamp((F.col("touches") - 2) / 4 + 0.5)
    return line.join(pierced, ["series", "side"], "left_anti").select("series", "side", F.col("first.node_ts").alias("first_ts"), F.col("first.price").alias("first_price"), F.col("last.node_ts").alias("last_ts"), F.col("last.price").alias("last_price"), "slope", "touches", fit.alias("fit"))


def chart_patterns(bars: DataFrame, depth: int = 3, backstep: int = 2, deviation: float = 1.0, atr: str | None = None, tolerance: float = 2.0, flat: float = 1.5, pending: int = 2, apart: bool = False) -> DataFrame:
    """chart_shapes over the bars' swing nodes with their outcomes; `apart`: only those that best_apart leaves."""
    found = chart_shapes(swing_nodes(bars, depth, backstep, deviation, atr), tolerance, flat, pending)
    return with_outcome(best_apart(found) if apart else found, bars)
