"""Price zones as rows: born on a bar, ended by a later one, met by bars in between.

Bars carry a number in their series and fall into blocks of SPAN bars with their extremes. A zone is compared with block
extremes first and with single bars only in blocks that can matter, so no zone is joined to all later bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 256


def _order():
    return Window.partitionBy("series").orderBy("ts")


def ranged_bars(bars: DataFrame, atr_len: int = 14) -> DataFrame:
    """`bars` with number i from 1, block, the bar before, and atr, the plain mean of the last `atr_len` true ranges."""
    w = _order()
    before = {f"prev_{c}": F.lag(c).over(w) for c in ("open", "high", "low", "close")}
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev_close")), F.abs(F.col("low") - F.col("prev_close")))
    rows = bars.select("series", "ts", "open", "high", "low", "close", F.row_number().over(w).cast("long").alias("i"), *[c.alias(n) for n, c in before.items()]).withColumn("tr", tr)
    last = w.rowsBetween(-(atr_len - 1), 0)
    atr = F.when(F.col("i") > atr_len, F.avg("tr").over(last))
    return rows.withColumn("atr", atr).withColumn("block", F.floor(F.col("i") / SPAN)).drop("tr")


def order_block_zones(ranged: DataFrame, min_disp: float = 1.0) -> DataFrame:
    """(series, birth, side, top, bottom): the bar before a strong one of the other colour; side 1 is demand, -1 supply."""
    body = F.col("close") - F.col("open")
    strong = ranged.filter(F.abs(body) >= min_disp * F.col("atr"))
    side = F.when((body > 0) & (F.col("prev_close") < F.col("prev_open")), 1).when((body < 0) & (F.col("prev_close") > F.col("prev_open")), -1)
    return strong.select("series", F.col("i").alias("birth"), side.alias("side"), F.col("prev_high").alias("top"), F.col("prev_low").alias("bottom")).filter("side IS NOT NULL")


def _blocks(ranged: DataFrame) -> DataFrame:
    return ranged.groupBy("series", "block").agg(F.min("close").alias("low_close"), F.max("close").alias("high_close"), F.min("low").alias("least"), F.max("high").alias("most"))


def with_death(zones: DataFrame, ranged: DataFrame) -> DataFrame:
    """`zones` with `death`, the first later bar that closes beyond the far side; null if none does."""
    key = ["series", "birth", "side"]
    bars = ranged.select("series", "block", "i", "close")
    past: Column = F.when(F.col("side") == 1, F.col("close") < F.col("bottom")).otherwise(F.col("close") > F.col("top"))
    block_past = F.when(F.col("side") == 1, F.col("low_close") < F.col("bottom")).otherwise(F.col("high_close") > F.col("top"))
    zones = zones.withColumn("own", F.floor(F.col("birth") / SPAN))
    near = zones.join(bars.withColumnRenamed("block", "own"), ["series", "own"]).filter((F.col("i") > F.col("birth")) & past).groupBy(*key).agg(F.min("i").alias("near"))
    later = zones.join(_blocks(ranged), "series").filter((F.col("block") > F.col("own")) & block_past).groupBy(*key, "top", "bottom").agg(F.min("block").alias("block"))
    far = later.join(bars, ["series", "block"]).filter(past).groupBy(*key).agg(F.min("i").alias("far"))
    return zones.join(near, key, "left").join(far, key, "left").withColumn("death", F.coalesce("near", "far")).drop("near", "far", "own")


def order_blocks(bars: DataFrame, atr_len: int = 14, min_disp: float = 1.0) -> DataFrame:
    """For each bar: value (demand minus supply zones alive), the newest zone alive with its age, zones born and retested.

    A zone lives from its birth bar to the bar before the one that closes beyond its far side; bars after its birth that
    reach into it are retests. NULL before `atr_len` + 1 bars.
    """
    ranged = ranged_bars(bars, atr_len)
    zones = with_death(order_block_zones(ranged, min_disp), ranged)
    moves = zones.select("series", F.col("birth").alias("i"), F.col("side").alias("move"), F.col("side").alias("born")).union(zones.filter("death IS NOT NULL").select("series", "death", -F.col("side"), F.lit(None).cast("int")))
    moves = moves.groupBy("series", "i").agg(F.sum("move").alias("move"), F.max("born").alias("born"))

    zones = zones.withColumn("from_block", F.floor(F.col("birth") / SPAN)).withColumn("to_block", F.floor(F.col("death") / SPAN))
    told = F.struct("birth", "top", "bottom")
    blocks = _blocks(ranged)
    covered = zones.join(blocks.select("series", "block"), "series").filter((F.col("block") > F.col("from_block")) & (F.col("to_block").isNull() | (F.col("block") < F.col("to_block"))))
    covered = covered.groupBy("series", "block").agg(F.max(told).alias("whole"))
    alive = (F.col("i") >= F.col("birth")) & (F.col("death").isNull() | (F.col("i") < F.col("death")))
    edges = zones.withColumn("block", F.explode(F.array_distinct(F.array_compact(F.array("from_block", "to_block")))))
    edges = edges.join(ranged.select("series", "block", "i"), ["series", "block"]).filter(alive).groupBy("series", "i").agg(F.max(told).alias("part"))

    reach = F.when(F.col("side") == 1, F.col("least") <= F.col("top")).otherwise(F.col("most") >= F.col("bottom"))
    touched = zones.join(blocks.select("series", "block", "least", "most"), "series").filter((F.col("block") >= F.col("from_block")) & (F.col("to_block").isNull() | (F.col("block") <= F.col("to_block"))) & reach)
    inside = F.when(F.col("side") == 1, F.col("low") <= F.col("top")).otherwise(F.col("high") >= F.col("bottom"))
    touched = touched.select("series", "block", "side", "birth", "death", "top", "bottom").join(ranged.select("series", "block", "i", "low", "high"), ["series", "block"]).filter(alive & (F.col("i") > F.col("birth")) & inside)
    touched = touched.groupBy("series", "i").agg(F.sum((F.col("side") == 1).cast("long")).alias("retest_bullish"), F.sum((F.col("side") == -1).cast("long")).alias("retest_bearish"))

    rows = ranged.select("series", "ts", "i", "block").join(moves, ["series", "i"], "left").join(edges, ["series", "i"], "left").join(covered, ["series", "block"], "left").join(touched, ["series", "i"], "left")
    ready = F.col("i") > atr_len
    value = F.sum(F.coalesce("move", F.lit(0))).over(_order().rowsBetween(Window.unboundedPreceding, 0))
    last = F.greatest(F.coalesce("part", "whole"), F.coalesce("whole", "part"))
    rows = rows.withColumn("last", last)
    none = lambda c: F.when(ready, F.coalesce(c, F.lit(0).cast("long")))
    return rows.select(
        "series", "ts", F.when(ready, value.cast("double")).alias("value"), F.col("last.top").alias("active_ob_top"), F.col("last.bottom").alias("active_ob_bottom"), (F.col("i") - F.col("last.birth")).alias("active_ob_duration"),
        none((F.col("born") == 1).cast("long")).alias("born_bullish"), none((F.col("born") == -1).cast("long")).alias("born_bearish"), none(F.col("retest_bullish")).alias("retest_bullish"), none(F.col("retest_bearish")).alias("retest_bearish"),
    )


def support_resistance(bars: DataFrame, pivot_len: int = 5, half_width: float = 0.0025, dedup: float = 0.005) -> DataFrame:
    """(series, kind, nth, price, top, bottom, strength, distance_pct, pivot_ts): the two nearest supports below and
    resistances above each series' last close.

    Levels are pivots that no bar within `pivot_len` exceeds, ties included. From the highest support down, and from the lowest
    resistance up, a level nearer than `dedup` times the last close to the one kept before it falls in with it, which takes the
    earlier time. Zones reach `half_width` times the last close to either side.
    """
    w = _order()
    near = w.rowsBetween(-pivot_len, pivot_len)
    full = F.count(F.lit(1)).over(near) == 2 * pivot_len + 1
    rows = bars.select("series", "ts", "close", F.when(full & (F.col("low") == F.min("low").over(near)), F.col("low")).alias("support"), F.when(full & (F.col("high") == F.max("high").over(near)), F.col("high")).alias("resistance"))
    level = lambda c, sign: F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct((sign * F.col(c)).alias("key"), F.col("ts")))))
    found = rows.groupBy("series").agg(F.max_by("close", "ts").alias("price"), level("support", -1).alias("support"), level("resistance", 1).alias("resistance"))
    kind = "array<struct<key:double,ts:timestamp_ntz>>"

    def kept(c: str) -> Column:
        def step(acc, x):
            last = F.element_at(acc, -1)
            joins = (F.size(acc) > 0) & (F.abs(F.try_element_at(acc, F.lit(-1))["key"] - x["key"]) < dedup * F.col("price"))
            merged = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["key"].alias("key"), F.least(last["ts"], x["ts"]).alias("ts"))))
            return F.when(joins, merged).otherwise(F.concat(acc, F.array(x)))

        return F.aggregate(c, F.array().cast(kind), step)

    below = F.slice(F.filter(kept("support"), lambda x: -x["key"] < F.col("price")), 1, 2)
    above = F.slice(F.filter(kept("resistance"), lambda x: x["key"] > F.col("price")), 1, 2)
    both = F.concat(F.transform(below, lambda x, k: F.struct(F.lit("support").alias("kind"), k.alias("k"), (-x["key"]).alias("price"), x["ts"].alias("pivot_ts"))), F.transform(above, lambda x, k: F.struct(F.lit("resistance").alias("kind"), k.alias("k"), x["key"].alias("price"), x["ts"].alias("pivot_ts"))))
    z = found.select("series", F.col("price").alias("last"), F.explode(both).alias("z"))
    p, last = F.col("z.price"), F.col("last")
    return z.select("series", F.col("z.kind").alias("kind"), (F.col("z.k") + 1).cast("int").alias("nth"), p.alias("price"), (p + half_width * last).alias("top"), (p - half_width * last).alias("bottom"), F.lit(0.8).alias("strength"), ((p - last) / last * 100).alias("distance_pct"), F.col("z.pivot_ts").alias("pivot_ts"))


def lifecycle(zones: DataFrame, bars: DataFrame, max_age: int = 200, atr_len: int = 14) -> DataFrame:
    """`zones` (zone, series, ts, kind, top, bottom) with state, present kind, touches, age, reaction, broken_ts and flipped_ts
    after the next `max_age` bars.

    States: active, touched (a bar overlaps the zone), reacted (a touched zone is closed out of on its own side), broken (a
    close beyond the far side by a fifth of the mean true range), flipped (a broken zone is entered again and closed beyond
    its far side; support turns to resistance and back). Each zone meets at most `max_age` bars, found by bar number.
    """
    ranged = ranged_bars(bars, atr_len).select("series", "ts", "i", "block", "low", "high", "close", F.coalesce("atr", F.lit(0.0)).alias("atr"))
    born = zones.join(ranged.select("series", "ts", F.col("i").alias("birth")), ["series", "ts"])
    spread = born.select("zone", "series", "birth", F.explode(F.sequence(F.floor((F.col("birth") + 1) / SPAN), F.floor((F.col("birth") + max_age) / SPAN))).alias("block"))
    met = spread.join(ranged.withColumnRenamed("ts", "at"), ["series", "block"]).filter((F.col("i") > F.col("birth")) & (F.col("i") <= F.col("birth") + max_age))
    lists = met.groupBy("zone").agg(F.sort_array(F.collect_list(F.struct("i", "at", "low", "high", "close", "atr"))).alias("bars"))
    shape = "struct<state:string,support:boolean,touches:int,age:int,reaction:double,broken:timestamp_ntz,flipped:timestamp_ntz>"
    top, bottom = F.col("top"), F.col("bottom")

    def step(s, b):
        sup = s["support"]
        inside = (b["low"] <= top) & (b["high"] >= bottom)
        through = F.when(sup, b["close"] < bottom - b["atr"] * 0.2).otherwise(b["close"] > top + b["atr"] * 0.2)
        flips = inside & F.when(sup, b["close"] < bottom).otherwise(b["close"] > top)
        leaves = (s["state"] == "touched") & F.when(sup, b["close"] > top).otherwise(b["close"] < bottom)
        edge = F.when(sup, top).otherwise(bottom)
        force = F.when(leaves & (b["atr"] > 0), F.greatest(s["reaction"], F.abs(b["close"] - edge) / b["atr"])).otherwise(s["reaction"])
        was_flipped, was_broken = s["state"] == "flipped", s["state"] == "broken"
        free = ~was_flipped & ~was_broken
        turned = was_broken & flips
        state = F.when(was_flipped, F.when(through, "broken").otherwise("flipped")).when(was_broken, F.when(flips, "flipped").otherwise("broken")).when(through, "broken").when(leaves, "reacted").when(inside, "touched").otherwise(s["state"])
        touched = turned | (free & inside & ~leaves)
        return F.struct(
            state.alias("state"), F.when(turned, ~sup).otherwise(sup).alias("support"), (s["touches"] + touched.cast("int")).alias("touches"), (s["age"] + 1).alias("age"),
            F.when(free, force).otherwise(s["reaction"]).alias("reaction"), F.when(through & ~was_broken, b["at"]).otherwise(s["broken"]).alias("broken"), F.when(turned, b["at"]).otherwise(s["flipped"]).alias("flipped"),
        ).cast(shape)

    start = F.struct(F.lit("active").alias("state"), (F.col("kind") == "support").alias("support"), F.lit(0).alias("touches"), F.lit(0).alias("age"), F.lit(0.0).alias("reaction"), F.lit(None).cast("timestamp_ntz").alias("broken"), F.lit(None).cast("timestamp_ntz").alias("flipped")).cast(shape)
    out = zones.join(lists, "zone", "left").withColumn("s", F.aggregate(F.coalesce("bars", F.array().cast("array<struct<i:long,at:timestamp_ntz,low:double,high:double,close:double,atr:double>>")), start, step))
    return out.select(*zones.columns, F.col("s.state").alias("state"), F.when(F.col("s.support"), "support").otherwise("resistance").alias("present_kind"), "s.touches", "s.age", "s.reaction", F.col("s.broken").alias("broken_ts"), F.col("s.flipped").alias("flipped_ts"))


def merge_zones(zones: DataFrame, margin: float = 0.0) -> DataFrame:
    """(series, kind, merged, top, bottom, members, first_ts): zones of a kind that overlap, or lie within `margin`, as one."""
    up = Window.partitionBy("series", "kind").orderBy("bottom", "top", "zone")
    reach = F.max("top").over(up.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.coalesce((F.col("bottom") > reach + margin).cast("int"), F.lit(0))
    runs = zones.withColumn("cut", cut).withColumn("run", F.sum("cut").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("series", "kind", "run").agg(F.min("zone").alias("merged"), F.max("top").alias("top"), F.min("bottom").alias("bottom"), F.count(F.lit(1)).alias("members"), F.min("ts").alias("first_ts")).drop("run")


def pivot_zones(bars: DataFrame, pivot_len: int = 5, width: float = 0.0025) -> DataFrame:
    """(zone, series, ts, kind, top, bottom): a zone around each tie-tolerant pivot, born on the bar that confirms it."""
    w = _order()
    last = w.rowsBetween(-2 * pivot_len, 0)
    rows = bars.select("series", "ts", F.row_number().over(w).alias("i"), F.lag("high", pivot_len).over(w).alias("h"), F.lag("low", pivot_len).over(w).alias("l"), F.max("high").over(last).alias("hh"), F.min("low").over(last).alias("ll")).filter(F.col("i") > 2 * pivot_len)
    each = F.array_compact(F.array(F.when(F.col("l") == F.col("ll"), F.struct(F.lit("support").alias("kind"), F.col("l").alias("price"))), F.when(F.col("h") == F.col("hh"), F.struct(F.lit("resistance").alias("kind"), F.col("h").alias("price")))))
    z = rows.select("series", "ts", "i", F.explode(each).alias("z"))
    name = F.concat_ws(":", "series", F.col("i").cast("string"), "z.kind")
    return z.select(name.alias("zone"), "series", "ts", F.col("z.kind").alias("kind"), (F.col("z.price") * (1 + width)).alias("top"), (F.col("z.price") * (1 - width)).alias("bottom"))
