"""What became of trade setups: target, stop or expiry, by an interval join of setups and later bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILLS = ("stop_first", "target_first", "nearest_to_open")
#: Bars of one bucket of the interval join.
BUCKET = 64
_SETUP = ["id", "series", "ts", "side", "entry", "target", "stop", "max_bars", "score", "agreement"]


def setup_error() -> Column:
    """Why a setup cannot be recorded, else null."""
    prices = [F.col(c).cast("double") for c in ("score", "agreement", "entry", "target", "stop")]
    finite = F.lit(True)
    for p in prices:
        finite = finite & F.coalesce(F.abs(p) < float("inf"), F.lit(False))
    e, t, s = (F.col(c) for c in ("entry", "target", "stop"))
    ordered = ((F.col("side") == "buy") & (s < e) & (e < t)) | ((F.col("side") == "sell") & (t < e) & (e < s))
    return F.when(~F.coalesce(F.col("side").isin("buy", "sell"), F.lit(False)), "unsupported_trigger").when(~finite, "non_finite").when(~ordered, "price_geometry").when(F.coalesce(F.col("max_bars") <= 0, F.lit(True)), "zero_duration")


def resolve(setups: DataFrame, bars: DataFrame, fill: str = "stop_first") -> DataFrame:
    """id, outcome (win, loss, expired, active), exit_price, realized_r, bars, mfe and mae of each valid setup.

    A setup is watched from the bar after its ts (which need not be a bar's) for max_bars bars. A bar that opens beyond a level
    has hit it there, at the open price, the target first; else `fill` says what a bar that spans both levels hits. What has
    not come to an end is active, with the bars and excursions so far. Setups and bars meet in buckets of bar numbers, so a
    bar is repeated for no setup that it cannot concern; ids must be unique.
    """
    if fill not in FILLS:
        raise ValueError(f"fill must be one of {FILLS}")
    order = Window.partitionBy("series").orderBy("ts")
    places = bars.select("series", "ts", "open", "high", "low", "close", F.lit(None).cast("string").alias("id"))
    given = setups.filter(setup_error().isNull()).select(*_SETUP)
    # the number of bars up to each setup's ts: setups come after a bar of the same time
    marks = places.select("series", "ts", F.lit(0).alias("kind"), "id").union(given.select("series", "ts", F.lit(1), F.col("id").cast("string")))
    seen = F.sum(1 - F.col("kind")).over(Window.partitionBy("series").orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, 0))
    starts = marks.withColumn("before", seen).filter("kind = 1").select(F.col("id").alias("key"), "before")
    watched = given.withColumn("key", F.col("id").cast("string")).join(starts, "key")
    first, last = F.col("before") + 1, F.col("before") + F.col("max_bars")
    watched = watched.withColumn("bucket", F.explode(F.sequence(F.floor(first / BUCKET), F.floor(last / BUCKET))))
    numbered = bars.withColumn("j", F.row_number().over(order)).select("series", F.floor(F.col("j") / BUCKET).alias("bucket"), "j", "open", "high", "low", "close")
    met = watched.join(numbered, ["series", "bucket"]).filter((F.col("j") >= first) & (F.col("j") <= last))

    buy = F.col("side") == "buy"
    up, down = F.col("high") - F.col("entry"), F.col("entry") - F.col("low")
    hit_t = F.when(buy, F.col("high") >= F.col("target")).otherwise(F.col("low") <= F.col("target"))
    hit_s = F.when(buy, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop"))
    open_t = F.when(buy, F.col("open") >= F.col("target")).otherwise(F.col("open") <= F.col("target"))
    open_s = F.when(buy, F.col("open") <= F.col("stop")).otherwise(F.col("open") >= F.col("stop"))
    both = {"stop_first": F.lit(False), "target_first": F.lit(True), "nearest_to_open": F.abs(F.col("open") - F.col("target")) < F.abs(F.col("open") - F.col("stop"))}[fill]
    wins = F.when(open_t, True).when(open_s, False).when(hit_t & hit_s, both).otherwise(hit_t)
    age = F.col("j") - F.col("before")
    so_far = Window.partitionBy("id").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    met = met.select(
        "id", "j", age.alias("bars"), (hit_t | hit_s | (age >= F.col("max_bars"))).alias("over"), F.when(wins, "win").when(hit_s, "loss").otherwise("expired").alias("outcome"),
        F.when(wins, F.when(open_t, F.col("open")).otherwise(F.col("target"))).when(hit_s, F.when(open_s, F.col("open")).otherwise(F.col("stop"))).otherwise(F.col("close")).alias("exit_price"),
        F.greatest(F.lit(0.0), F.max(F.when(buy, up).otherwise(down)).over(so_far)).alias("mfe"), F.greatest(F.lit(0.0), F.max(F.when(buy, down).otherwise(up)).over(so_far)).alias("mae"),
    )
    end = met.groupBy("id").agg(F.min_by(F.struct("outcome", "exit_price", "bars", "mfe", "mae"), F.when(F.col("over"), F.col("j"))).alias("end"), F.max_by(F.struct("bars", "mfe", "mae"), "j").alias("now"))
    done = F.col("end").isNotNull()
    out = given.join(end, "id", "left").withColumn("sign", F.when(F.col("side") == "buy", 1.0).otherwise(-1.0))
    risk = F.greatest(F.abs(F.col("entry") - F.col("stop")), F.lit(1e-8))
    pick = lambda c: F.when(done, F.col(f"end.{c}")).otherwise(F.col(f"now.{c}"))
    return out.select(
        *_SETUP, F.when(done, F.col("end.outcome")).otherwise("active").alias("outcome"), F.when(done, F.col("end.exit_price")).alias("exit_price"),
        F.when(done, F.col("sign") * (F.col("end.exit_price") - F.col("entry")) / risk).alias("realized_r"),
        F.coalesce(pick("bars"), F.lit(0).cast("long")).alias("bars"), F.coalesce(pick("mfe"), F.lit(0.0)).alias("mfe"), F.coalesce(pick("mae"), F.lit(0.0)).alias("mae"),
    )
