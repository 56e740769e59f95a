"""Joins in time: exact pairs, backward as-of, N-way alignment, forward fill, and statistics over aligned series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _order(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy("ts")


def pair(primary: DataFrame, reference: DataFrame) -> DataFrame:
    """(ts, close_a, close_b) on equal timestamps; of duplicates in the reference the last price by bar time counts."""
    ref = reference.groupBy("ts").agg(F.max_by("close", "ts").alias("close_b"))
    return primary.select("ts", F.col("close").alias("close_a")).join(ref, "ts")


def series_pairs(bars: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b, ts, close_a, close_b) of the wanted pairs (a, b) of series on equal timestamps; by default all with a < b."""
    if pairs is None:
        names = bars.select("series").distinct()
        pairs = names.withColumnRenamed("series", "a").join(names.withColumnRenamed("series", "b"), F.col("a") < F.col("b"))
    left = bars.select(F.col("series").alias("a"), "ts", F.col("close").alias("close_a"))
    right = bars.select(F.col("series").alias("b"), "ts", F.col("close").alias("close_b"))
    return pairs.join(left, "a").join(right, ["b", "ts"]).select("a", "b", "ts", "close_a", "close_b")


def pair_regression(pairs: DataFrame, lookback: int = 30) -> DataFrame:
    """Rolling beta, alpha, correlation and r2 of log returns of paired bars."""
    w = _order("a", "b")
    frame = w.rowsBetween(-(lookback - 1), 0)
    r = pairs.withColumn("ra", F.log(F.col("close_a") / F.lag("close_a").over(w))).withColumn("rb", F.log(F.col("close_b") / F.lag("close_b").over(w))).withColumn("n", F.count("ra").over(frame))
    full = F.col("n") >= lookback
    out = r.withColumn("beta", F.when(full, F.regr_slope("ra", "rb").over(frame))).withColumn("alpha", F.when(full, F.avg("ra").over(frame) - F.col("beta") * F.avg("rb").over(frame)))
    out = out.withColumn("corr", F.when(full, F.corr("ra", "rb").over(frame)))
    return out.select("a", "b", "ts", "beta", "alpha", "corr", (F.col("corr") * F.col("corr")).alias("r2"))


def rolling_beta(pairs: DataFrame, length: int = 60) -> DataFrame:
    """Beta, alpha, correlation and its square of the last `length` simple returns; none while the reference does not vary."""
    w = _order("a", "b")
    frame = w.rowsBetween(-(length - 1), 0)
    change = lambda c: F.col(c) / F.lag(c).over(w) - 1
    r = pairs.withColumns({"ra": change("close_a"), "rb": change("close_b")}).filter("ra is not null and rb is not null")
    r = r.withColumns({"n": F.count("ra").over(frame), "cov": F.covar_pop("ra", "rb").over(frame), "vb": F.var_pop("rb").over(frame), "va": F.var_pop("ra").over(frame), "ma": F.avg("ra").over(frame), "mb": F.avg("rb").over(frame)})
    r = r.filter((F.col("n") >= length) & (F.col("vb") * length > 1e-14)).withColumn("beta", F.col("cov") / F.col("vb"))
    corr = F.when(F.col("va") * length > 1e-14, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cov") / F.sqrt(F.col("va") * F.col("vb"))))).otherwise(0.0)
    return r.select("a", "b", "ts", "beta", (F.col("ma") - F.col("beta") * F.col("mb")).alias("alpha"), corr.alias("correlation"), (corr * corr).alias("r_squared"))


def pair_spread(pairs: DataFrame, length: int = 60) -> DataFrame:
    """z-score of the last close's residual in the window's regression of closes, with hedge ratio, spread, its mean and deviation."""
    frame = _order("a", "b").rowsBetween(-(length - 1), 0)
    r = pairs.withColumns({"n": F.count("close_a").over(frame), "cov": F.covar_pop("close_a", "close_b").over(frame), "vb": F.var_pop("close_b").over(frame), "va": F.var_pop("close_a").over(frame), "ma": F.avg("close_a").over(frame), "mb": F.avg("close_b").over(frame)})
    r = r.filter((F.col("n") >= length) & (F.col("vb") * length > 1e-14)).withColumn("hedge_ratio", F.col("cov") / F.col("vb"))
    r = r.withColumns({"spread": F.col("close_a") - F.col("hedge_ratio") * F.col("close_b"), "mean_spread": F.col("ma") - F.col("hedge_ratio") * F.col("mb"), "std_spread": F.sqrt(F.greatest(F.lit(0.0), F.col("va") - F.col("cov") * F.col("hedge_ratio")))})
    z = F.when(F.col("std_spread") > 1e-14, (F.col("spread") - F.col("mean_spread")) / F.col("std_spread")).otherwise(0.0)
    return r.select("a", "b", "ts", z.alias("z"), "hedge_ratio", "spread", "mean_spread", "std_spread")


def as_of(left: DataFrame, right: DataFrame, value: str, bucket: str = "day") -> DataFrame:
    """`left` (series, ts, ...) with the latest `value` of `right` (series, ts, value) at or before its ts.

    A union, one exchange on series and time bucket, and a running last value inside each; what a bucket starts with comes
    from a small table of the buckets' last values. So one long series is spread over many tasks, without a range join.
    """
    marked = right.select("series", "ts", F.col(value).alias("_v"), F.lit(0).alias("_side"))
    both = left.withColumns({"_v": F.lit(None).cast(marked.schema["_v"].dataType), "_side": F.lit(1)}).unionByName(marked, allowMissingColumns=True)
    both = both.withColumn("_bucket", F.date_trunc(bucket, F.col("ts").cast("timestamp")))
    lasts = both.groupBy("series", "_bucket").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("ts"))).alias("_last"))
    earlier = Window.partitionBy("series").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("series", "_bucket", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    w = Window.partitionBy("series", "_bucket").orderBy("ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_in", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    return inside.join(carried, ["series", "_bucket"], "left").withColumn(value, F.coalesce("_in", "_carried")).select(*left.columns, value)


def complete_times(bars: DataFrame) -> DataFrame:
    """Bars at those timestamps that every series has."""
    total = bars.select(F.count_distinct("series").alias("total"))
    times = bars.groupBy("ts").agg(F.count_distinct("series").alias("k")).join(F.broadcast(total), F.col("k") == F.col("total")).select("ts")
    return bars.join(times, "ts", "left_semi")


def aligned_returns(bars: DataFrame) -> DataFrame:
    """(series, ts, ret): simple returns over commonly present timestamps."""
    aligned = complete_times(bars)
    return aligned.select("series", "ts", (F.col("close") / F.lag("close").over(_order("series")) - 1).alias("ret")).filter("ret is not null")


def correlation_matrix(bars: DataFrame) -> DataFrame:
    """One row for each unordered pair of series: correlation and count of aligned returns."""
    r = aligned_returns(bars)
    a, b = r.withColumnsRenamed({"series": "a", "ret": "ra"}), r.withColumnsRenamed({"series": "b", "ret": "rb"})
    return a.join(b, "ts").filter("a < b").groupBy("a", "b").agg(F.corr("ra", "rb").alias("corr"), F.count(F.lit(1)).alias("n"))


def forward_fill(bars: DataFrame, seconds: int, max_age: int) -> DataFrame:
    """A full grid for each series; gaps take the last close for at most `max_age` steps, with volume 0 and a flag."""
    step = F.expr(f"interval {seconds} seconds")
    grid = bars.groupBy("series").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).select("series", F.explode(F.sequence("lo", "hi", step)).alias("ts"))
    w = _order("series").rowsBetween(Window.unboundedPreceding, 0)
    joined = grid.join(bars, ["series", "ts"], "left").withColumn("real", F.col("close").isNotNull())
    filled = joined.withColumn("last_close", F.last("close", ignorenulls=True).over(w)).withColumn("last_ts", F.last(F.when(F.col("real"), F.col("ts")), ignorenulls=True).over(w))
    age = ((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("last_ts").cast("timestamp"))) / seconds).cast("long")
    return filled.withColumn("age", age).filter(F.col("age") <= max_age).select("series", "ts", F.col("last_close").alias("close"), F.coalesce("volume", F.lit(0.0)).alias("volume"), (~F.col("real")).alias("is_forward_filled"), "age")
