"""Cross-sections and aggregates: strength ranks, breadth, drawdowns, return metrics, tail risk, seasonality, regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .align import complete_times

def _ordered():
    return Window.partitionBy("series").orderBy("ts")


def _running():
    return _ordered().rowsBetween(Window.unboundedPreceding, 0)


def relative_strength(bars: DataFrame, lookback: int = 20) -> DataFrame:
    """At each common time: the return over `lookback` bars, its rank and percentile among the series."""
    r = complete_times(bars).select("series", "ts", (F.col("close") / F.lag("close", lookback).over(_ordered()) - 1).alias("ret")).filter("ret is not null")
    w = Window.partitionBy("ts")
    return r.withColumn("place", F.rank().over(w.orderBy(F.desc("ret")))).withColumn("share", F.percent_rank().over(w.orderBy("ret")))


def market_breadth(bars: DataFrame, lookback: int = 20) -> DataFrame:
    """At each time: members above their mean, advancing, declining, and the shares."""
    m = bars.select("series", "ts", "close", F.avg("close").over(_ordered().rowsBetween(-(lookback - 1), 0)).alias("mean"), F.lag("close").over(_ordered()).alias("pc"), F.row_number().over(_ordered()).alias("i")).filter(F.col("i") >= lookback)
    count = lambda c: F.sum(c.cast("long"))
    out = m.groupBy("ts").agg(F.count(F.lit(1)).alias("members"), count(F.col("close") > F.col("mean")).alias("above"), count(F.col("close") > F.col("pc")).alias("advancing"), count(F.col("close") < F.col("pc")).alias("declining"))
    return out.withColumn("share_above", F.col("above") / F.col("members"))


def drawdown(bars: DataFrame) -> DataFrame:
    """For each series: the deepest fall of the close from its running peak, as a share, and the bars under water."""
    d = bars.select("series", "close", F.max("close").over(_running()).alias("peak")).withColumn("dd", (F.col("peak") - F.col("close")) / F.col("peak"))
    return d.groupBy("series").agg(F.max("dd").alias("max_drawdown"), F.avg("dd").alias("mean_drawdown"), F.sum((F.col("dd") > 0).cast("long")).alias("bars_under_water"))


def return_metrics(bars: DataFrame, risk_free: float = 0.0, periods_per_year: float = 252.0) -> DataFrame:
    """For each series: mean and sample deviation of log returns, Sharpe and Sortino, annualised; 0 where the deviation is."""
    r = bars.select("series", F.log(F.col("close") / F.lag("close").over(_ordered())).alias("r")).filter("r is not null")
    target = risk_free / periods_per_year
    below = F.least(F.col("r") - target, F.lit(0.0))
    m = r.groupBy("series").agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("dev"), F.sqrt(F.avg(below * below)).alias("down"))
    scale = periods_per_year**0.5
    per = lambda c: F.when(F.col(c) <= 1e-12, 0.0).otherwise((F.col("mean") - target) / F.col(c) * scale)
    return m.select("series", "n", "mean", "dev", per("dev").alias("sharpe"), per("down").alias("sortino"))


def value_at_risk(bars: DataFrame, confidence: float = 0.95) -> DataFrame:
    """For each series: historical VaR and expected shortfall of simple returns over the worst ceil((1-c) n)."""
    r = bars.select("series", (F.col("close") / F.lag("close").over(_ordered()) - 1).alias("r")).filter("r is not null")
    n = F.count(F.lit(1)).over(Window.partitionBy("series"))
    ranked = r.withColumn("k", F.row_number().over(Window.partitionBy("series").orderBy("r"))).withColumn("tail", F.greatest(F.lit(1), F.least(n, F.ceil(F.lit(1 - confidence) * n))))
    worst = ranked.filter("k <= tail")
    return worst.groupBy("series").agg(F.greatest(F.lit(0.0), -F.max("r")).alias("var"), F.avg(F.greatest(F.lit(0.0), -F.col("r"))).alias("es"), F.count(F.lit(1)).alias("tail"))


def seasonality(bars: DataFrame, unit: Column, name: str) -> DataFrame:
    """Mean, sample deviation, share of gains and count of bar returns by a calendar unit."""
    r = bars.select("series", unit.alias(name), (F.col("close") / F.lag("close").over(_ordered()) - 1).alias("r")).filter("r is not null")
    return r.groupBy("series", name).agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("dev"), F.avg((F.col("r") > 0).cast("double")).alias("share_up"), F.count(F.lit(1)).alias("n"))


def price_stats(bars: DataFrame) -> DataFrame:
    """Mergeable statistics of closes by series (map-side partial sums): count, mean, deviation, extremes, quartiles."""
    return bars.groupBy("series").agg(F.count("close").alias("n"), F.avg("close").alias("mean"), F.stddev_samp("close").alias("dev"), F.min("close").alias("low"), F.max("close").alias("high"), F.percentile("close", F.lit(0.25)).alias("q1"), F.percentile("close", F.lit(0.5)).alias("median"), F.percentile("close", F.lit(0.75)).alias("q3"))


def wilson(successes: Column, trials: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a proportion's Wilson interval."""
    p, z2 = successes / trials, z * z
    middle = (p + z2 / (2 * trials)) / (1 + z2 / trials)
    half = z * F.sqrt(p * (1 - p) / trials + z2 / (4 * trials * trials)) / (1 + z2 / trials)
    return middle - half, middle + half


def longest_run(bars: DataFrame) -> DataFrame:
    """For each series the longest run of rising closes (gaps and islands)."""
    up = bars.select("series", "ts", (F.col("close") > F.lag("close").over(_ordered())).alias("up"))
    island = up.withColumn("island", F.sum(F.when(F.coalesce("up", F.lit(False)), 0).otherwise(1)).over(_running()))
    runs = island.filter("up").groupBy("series", "island").agg(F.count(F.lit(1)).alias("n"))
    return bars.select("series").distinct().join(runs.groupBy("series").agg(F.max("n").alias("m")), "series", "left").select("series", F.coalesce("m", F.lit(0)).alias("longest"))
