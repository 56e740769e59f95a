"""Profiles over a rolling window of bars: array expressions on the window's bars, one exchange, no Python.

`extended_profile` cuts the window's own range into bins. The persistent profile lives on a fixed grid of prices instead: as volume
changes only where a bar begins or ends, it is swept by segments between those edges, so a fine grid costs no more than a coarse one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bound(value: Column, body) -> Column:
    """body(value) with the value worked out once: a column used inside a lambda may be worked out anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _value_area(flow: Column, poc: Column, wanted: Column, rows: int, tie_up: bool = False) -> Column:
    """struct<lo, hi, held>: bins around `poc`, grown by the neighbour with more flow (the lower on a tie, or the upper) until they hold `wanted`."""
    start = F.struct(poc.alias("lo"), poc.alias("hi"), F.get(flow, poc).alias("held"))

    def grow(s: Column, _: Column) -> Column:
        below = F.when(s["lo"] > 0, F.get(flow, s["lo"] - 1)).otherwise(-1.0)
        above = F.when(s["hi"] < rows - 1, F.get(flow, s["hi"] + 1)).otherwise(-1.0)
        grows = (s["held"] < wanted) & (F.greatest(below, above) >= 0)
        first = below > above if tie_up else below >= above
        down, up = grows & first, grows & ~first
        return F.struct((s["lo"] - down.cast("int")).alias("lo"), (s["hi"] + up.cast("int")).alias("hi"), (s["held"] + F.when(down, below).when(up, above).otherwise(0.0)).alias("held"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rows)), start, grow)


def money_flow_profile(bars: DataFrame, lookback: int = 200, rows: int = 25, va_pct: float = 0.7) -> DataFrame:
    """For each bar: value (the middle of the bin with the most flow, the upper on a tie), vah, val, delta_poc, bull_pct and
    four events with their strengths.

    The range of the last `lookback` bars is cut into `rows` bins. A bar gives each bin volume (1 if not positive) x the share
    of its range inside the bin x the bin's middle; the part bought is that times where the close lies in the range. Bars
    without a range give nothing. vah and val bound the bins that hold `va_pct` of the flow; delta_poc is the bin where
    bought and sold differ most (the first). NULL for a series' first bar and while there is no flow. An event compares with
    the last bar that had values.
    """
    w = Window.partitionBy("series").orderBy("ts")
    last = w.rowsBetween(-(lookback - 1), 0)
    size = F.when(F.col("volume") > 0, F.col("volume")).otherwise(1.0)
    span = F.col("high") - F.col("low")
    bar = F.when(span > 0, F.struct("high", "low", span.alias("span"), size.alias("size"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("close") - F.col("low")) / span)).alias("bought")))
    seen = bars.select("series", "ts", "close", F.collect_list(bar).over(last).alias("bars"), F.min("low").over(last).alias("bottom"), F.max("high").over(last).alias("top"), F.row_number().over(w).alias("i"))
    height = (F.col("top") - F.col("bottom")) / rows

    def of_bin(r: Column) -> Column:
        low, middle = F.col("bottom") + r * height, F.col("bottom") + (r + 0.5) * height

        def add(acc: Column, b: Column) -> Column:
            inside = F.greatest(F.lit(0.0), F.least(b["high"], low + height) - F.greatest(b["low"], low)) / b["span"]
            flow = b["size"] * inside * middle
            return F.struct((acc["flow"] + flow).alias("flow"), (acc["bought"] + flow * b["bought"]).alias("bought"))

        return F.aggregate("bars", F.struct(F.lit(0.0).alias("flow"), F.lit(0.0).alias("bought")), add)

    ready = (F.col("i") > 1) & (F.col("top") > F.col("bottom"))
    binned = seen.select("series", "ts", "close", "bottom", height.alias("height"), F.when(ready, F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), of_bin)).alias("bins"))
    total = lambda c: F.aggregate(F.col(f"bins.{c}"), F.lit(0.0), lambda a, x: a + x)
    most = F.array_max("bins.flow")
    tilt = F.transform("bins", lambda b: F.abs(2 * b["bought"] - b["flow"]))
    sums = binned.withColumn("bins", F.when(most > 0, F.col("bins"))).select(
        "series", "ts", "close", "bottom", "height", F.col("bins.flow").alias("flow"), total("flow").alias("whole"), total("bought").alias("bought"),
        (rows - F.array_position(F.reverse("bins.flow"), most)).cast("int").alias("poc"), (F.array_position(tilt, F.array_max(tilt)) - 1).alias("tilted"),
    )
    area = sums.withColumn("area", F.when(F.col("poc").isNotNull(), _value_area(F.col("flow"), F.col("poc"), F.col("whole") * va_pct, rows)))
    at = lambda k: F.col("bottom") + k * F.col("height")
    out = area.select("series", "ts", "close", at(F.col("poc") + 0.5).alias("value"), at(F.col("area.hi") + 1).alias("vah"), at(F.col("area.lo")).alias("val"), at(F.col("tilted") + 0.5).alias("delta_poc"), (F.col("bought") / F.col("whole") * 100).alias("bull_pct"))

    told = F.when(F.col("value").isNotNull(), F.struct("close", "vah", "val", "bull_pct"))
    before = F.last(told, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("was", before)
    flag = lambda c: F.when(F.col("value").isNotNull(), F.coalesce(c, F.lit(False)))
    width = F.col("vah") - F.col("val")
    beyond = lambda fired, d: F.when(fired, F.when(width > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), d / width))).otherwise(1.0))
    over = flag((F.col("was.close") <= F.col("was.vah")) & (F.col("close") > F.col("vah")))
    under = flag((F.col("was.close") >= F.col("was.val")) & (F.col("close") < F.col("val")))
    return out.select(
        "series", "ts", "value", "vah", "val", "delta_poc", "bull_pct", over.alias("bull_value_area_break"), under.alias("bear_value_area_break"),
        flag((F.col("was.bull_pct") <= 50) & (F.col("bull_pct") > 50)).alias("bull_bias"), flag((F.col("was.bull_pct") >= 50) & (F.col("bull_pct") < 50)).alias("bear_bias"),
        F.coalesce(beyond(over, F.col("close") - F.col("vah")), beyond(under, F.col("val") - F.col("close"))).alias("strength"),
    )


def _sized(bars: DataFrame) -> DataFrame:
    """`bars` with size (the range where there is no volume) and bought, the share of it by where the close lies in the range."""
    span = F.col("high") - F.col("low")
    place = F.when(span > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("close") - F.col("low")) / span))).otherwise(0.5)
    return bars.select("series", "ts", "high", "low", F.when(F.col("volume") > 0, F.col("volume")).otherwise(span).alias("size"), F.when(F.col("volume") > 0, place).otherwise(0.5).alias("bought"))


def extended_profile(bars: DataFrame, lookback: int = 70, rows: int = 30, high_node: float = 1.5, low_node: float = 0.5, va_pct: float = 0.7) -> DataFrame:
    """For each bar: value (middle of the first bin with the most volume), vah, val, from_ts, bottom, height, volumes, deltas and zones.

    A bar's volume is spread evenly over the bins that it touches. vah and val bound the bins that hold `va_pct` of it, grown to the
    side with more (up on a tie). deltas: bought less sold. zones: runs of bins with at least `high_node` (hvn_zone), at most
    `low_node` (lvn_zone) times the mean volume, as (kind, bottom, top, strength), strength the share of all volume. NULL before the
    `lookback`-th bar and while the window has no range.
    """
    w = Window.partitionBy("series").orderBy("ts")
    last = w.rowsBetween(-(lookback - 1), 0)
    seen = _sized(bars).select("series", "ts", F.collect_list(F.struct("low", "high", "size", "bought")).over(last).alias("bars"), F.min("low").over(last).alias("bottom"), F.max("high").over(last).alias("top"), F.min("ts").over(last).alias("from_ts"), F.row_number().over(w).alias("i"))
    ready = (F.col("i") >= lookback) & (F.col("top") - F.col("bottom") >= 1e-8)
    cut = seen.withColumn("height", F.when(ready, (F.col("top") - F.col("bottom")) / rows))
    bin_of = lambda p: F.least(F.floor((p - F.col("bottom")) / F.col("height")).cast("int"), F.lit(rows - 1))

    def place(b: Column) -> Column:
        lo, hi = bin_of(b["low"]), bin_of(b["high"])
        return F.struct(lo.alias("lo"), hi.alias("hi"), (b["size"] / (hi - lo + 1)).alias("each"), b["bought"].alias("bought"))

    def of_bin(placed: Column, r: Column) -> Column:
        def add(acc: Column, b: Column) -> Column:
            inside = F.when((b["lo"] <= r) & (b["hi"] >= r), b["each"]).otherwise(0.0)
            return F.struct((acc["volume"] + inside).alias("volume"), (acc["delta"] + inside * (2 * b["bought"] - 1)).alias("delta"))

        return F.aggregate(placed, F.struct(F.lit(0.0).alias("volume"), F.lit(0.0).alias("delta")), add)

    places = F.sequence(F.lit(0), F.lit(rows - 1))
    bins = F.when(F.col("height").isNotNull(), _bound(F.transform("bars", place), lambda placed: F.transform(places, lambda r: of_bin(placed, r))))
    binned = cut.select("series", "ts", "from_ts", "bottom", "height", bins.alias("bins")).select("series", "ts", "from_ts", "bottom", "height", F.col("bins.volume").alias("volumes"), F.col("bins.delta").alias("deltas"))
    total = F.aggregate("volumes", F.lit(0.0), lambda a, x: a + x)
    poc = (F.array_position("volumes", F.array_max("volumes")) - 1).cast("int")
    summed = binned.withColumns({"total": total, "poc": poc})
    area = summed.withColumn("area", F.when(F.col("poc").isNotNull(), _bound(F.struct(F.col("volumes").alias("flow"), F.col("poc").alias("poc"), (F.col("total") * va_pct).alias("wanted")), lambda a: _value_area(a["flow"], a["poc"], a["wanted"], rows, tie_up=True))))
    at = lambda k: F.col("bottom") + k * F.col("height")

    def zones_of(whole: Column) -> Column:
        volumes, mean, bottom, height = whole["volumes"], whole["total"] / rows, whole["bottom"], whole["height"]

        def runs(classes: Column) -> Column:
            of = lambda k: F.get(classes, k)

            def zone(k: Column) -> Column:
                end = F.coalesce(F.array_min(F.filter(places, lambda j: (j > k) & (of(j) != of(k)))), F.lit(rows))
                held = F.aggregate(F.slice(volumes, k + 1, end - k), F.lit(0.0), lambda a, x: a + x)
                kind = F.when(of(k) > 0, "hvn_zone").otherwise("lvn_zone")
                return F.struct(kind.alias("kind"), (bottom + k * height).alias("bottom"), (bottom + end * height).alias("top"), F.when(mean > 0, held / whole["total"]).otherwise(0.0).alias("strength"))

            return F.transform(F.filter(places, lambda k: (of(k) != 0) & ((k == 0) | (of(k - 1) != of(k)))), zone)

        return _bound(F.transform(volumes, lambda v: F.when(v >= mean * high_node, 1).when(v <= mean * low_node, -1).otherwise(0)), runs)

    zones = F.when(F.col("poc").isNotNull(), _bound(F.struct("volumes", "total", "bottom", "height"), zones_of))
    return area.select("series", "ts", at(F.col("poc") + 0.5).alias("value"), at(F.col("area.hi") + 1).alias("vah"), at(F.col("area.lo")).alias("val"), F.when(F.col("height").isNotNull(), F.col("from_ts")).alias("from_ts"), "bottom", "height", "volumes", "deltas", zones.alias("zones"))


def _gridded(bars: DataFrame, width: float, widest: int) -> DataFrame:
    """(series, ts, j, lo, hi, each): bars on the grid, numbered from 1; those over more than `widest` bins or without numbers are left out."""
    fine = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf")) & ~F.isnan(c)
    sized = _sized(bars.filter(fine("low") & fine("high") & fine("volume") & (F.col("high") >= F.col("low"))))
    key = lambda c: F.floor(F.col(c) / width)
    spans = sized.filter(F.floor(F.col("high") / width) - F.floor(F.col("low") / width) < widest)
    placed = spans.select("series", "ts", key("low").cast("long").alias("lo"), key("high").cast("long").alias("hi"), "size")
    return placed.select("series", "ts", F.row_number().over(Window.partitionBy("series").orderBy("ts")).cast("long").alias("j"), "lo", "hi", (F.col("size") / (F.col("hi") - F.col("lo") + 1)).alias("each"))


def persistent_profile(bars: DataFrame, lookback: int = 70, width: float = 1.0, absorption: float = 2.5, widest: int = 100_000) -> DataFrame:
    """For each bar that counts, from the `lookback`-th on: value (middle of the lowest bin with the most volume), n_bins, threshold
    and absorbing.

    Bin k holds the prices from k x `width` on. A bar's volume is spread evenly over its bins and leaves with it; bins that no bar of
    the window touches do not exist. threshold: the median volume for each touch, plus `absorption` times 1.4826 times the median
    distance from it; absorbing: segments (first, last, touches, volume, last_ts) of bins above it, whose bins are alike.
    """
    w = Window.partitionBy("series").orderBy("j")
    last = w.rowsBetween(-(lookback - 1), 0)
    seen = _gridded(bars, width, widest).select("series", "ts", "j", F.collect_list(F.struct("lo", "hi", "each", "ts")).over(last).alias("bars")).filter(F.col("j") >= lookback)
    ends = F.array_sort(F.array_distinct(F.concat(F.transform("bars", lambda b: b["lo"]), F.transform("bars", lambda b: b["hi"] + 1))))

    def segment(first: Column, stop: Column) -> Column:
        over = F.filter("bars", lambda b: (b["lo"] <= first) & (b["hi"] >= first))
        return F.struct(first.alias("first"), stop.alias("stop"), F.size(over).alias("touches"), F.aggregate(over, F.lit(0.0), lambda a, b: a + b["each"]).alias("volume"), F.array_max(over["ts"]).alias("last_ts"))

    segments = _bound(ends, lambda edges: F.zip_with(edges, F.slice(edges, 2, F.size(edges)), segment))
    swept = seen.select("series", "ts", F.filter(segments, lambda s: s["touches"] > 0).alias("live"))
    rated = swept.withColumns({"most": F.array_max("live.volume"), "n_bins": F.aggregate("live", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["first"]), "rates": F.transform("live", lambda s: F.struct((s["volume"] / s["touches"]).alias("x"), (s["stop"] - s["first"]).alias("n")))})
    peak = _bound(F.col("most"), lambda most: F.get(F.filter("live", lambda s: s["volume"] == most), F.lit(0))["first"])
    middle = rated.withColumn("median", _weighted_median(F.col("rates"), F.col("n_bins")))
    away = _bound(F.col("median"), lambda m: F.transform("rates", lambda r: F.struct(F.abs(r["x"] - m).alias("x"), r["n"].alias("n"))))
    bound = middle.withColumn("threshold", F.col("median") + absorption * 1.482602218505602 * _weighted_median(away, F.col("n_bins")))
    loud = _bound(F.col("threshold"), lambda least: F.filter("live", lambda s: s["volume"] / s["touches"] > least))
    return bound.select("series", "ts", ((peak + 0.5) * width).alias("value"), "n_bins", "threshold", F.transform(loud, lambda s: F.struct(s["first"].alias("first"), (s["stop"] - 1).alias("last"), s["touches"].alias("touches"), s["volume"].alias("volume"), s["last_ts"].alias("last_ts"))).alias("absorbing"))


def _weighted_median(pairs: Column, count: Column) -> Column:
    """The median of values x that stand n times each, `count` in all; between the two middle ones for an even count."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))

    def of(places: Column) -> Column:
        def step(a: Column, p: Column) -> Column:
            after = a["n"] + p["n"]
            pick = lambda name: F.when((a["n"] <= places[name]) & (places[name] < after), p["x"]).otherwise(a[name]).alias(name)
            return F.struct(after.alias("n"), pick("low"), pick("high"))

        return F.aggregate(F.array_sort(pairs), start, step, lambda a: (a["low"] + a["high"]) / 2)

    return _bound(F.struct(F.floor((count - 1) / 2).alias("low"), F.ceil((count - 1) / 2).alias("high")), of)


def bin_lives(bars: DataFrame, lookback: int = 70, width: float = 1.0, widest: int = 100_000) -> DataFrame:
    """(series, bin, bottom, top, born_ts, last_ts, touches, volume, expired_ts): each bin from the touch that made it to the bar on
    which the last bar that touched it left the window (null: not yet). A touch on that very bar keeps it alive."""
    grid = _gridded(bars, width, widest)
    leaves = grid.withColumn("left_ts", F.lead("ts", lookback).over(Window.partitionBy("series").orderBy("j")))
    touched = leaves.select("series", F.explode(F.sequence("lo", "hi")).alias("bin"), "ts", "j", "each", "left_ts")
    w = Window.partitionBy("series", "bin").orderBy("j")
    lives = touched.withColumn("life", F.sum(F.coalesce(F.col("j") - F.lag("j").over(w) > lookback, F.lit(True)).cast("int")).over(w))
    each = lives.groupBy("series", "bin", "life").agg(F.min("ts").alias("born_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("touches"), F.sum("each").alias("volume"), F.max_by("left_ts", "j").alias("expired_ts"))
    return each.select("series", "bin", (F.col("bin") * width).alias("bottom"), ((F.col("bin") + 1) * width).alias("top"), "born_ts", "last_ts", "touches", "volume", "expired_ts")


def absorption_zones(profile: DataFrame, lives: DataFrame, width: float = 1.0) -> DataFrame:
    """(series, ts, bottom, top, strength, touches, from_ts, last_ts): a row for each absorbing bin of each bar of persistent_profile,
    strength its volume for each touch up to 1, from_ts when the bin was made."""
    each = profile.select("series", "ts", F.explode_outer("absorbing").alias("s")).filter("s IS NOT NULL").select("series", "ts", F.explode(F.sequence("s.first", "s.last")).alias("bin"), "s.touches", (F.col("s.volume") / F.col("s.touches")).alias("rate"), "s.last_ts")
    made = lives.select("series", "bin", "born_ts", F.col("expired_ts").alias("gone_ts"))
    met = each.join(made, ["series", "bin"]).filter((F.col("born_ts") <= F.col("ts")) & (F.col("gone_ts").isNull() | (F.col("ts") < F.col("gone_ts"))))
    return met.select("series", "ts", (F.col("bin") * width).alias("bottom"), ((F.col("bin") + 1) * width).alias("top"), F.least(F.col("rate"), F.lit(1.0)).alias("strength"), "touches", F.col("born_ts").alias("from_ts"), "last_ts")
