"""Statistics of series and trades: rolling order statistics, clustered errors, Sharpe ratios, trade summaries, levels, splits."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.finance import normal_cdf

#: Makes the median absolute deviation of a normal sample estimate its standard deviation.
MAD_SCALE = 1.4826
#: Shares of a swing at which retracements and extensions are drawn.
FIBONACCI = (0.236, 0.382, 0.5, 0.618, 0.786, 1.0, 1.272, 1.618)
EULER = 0.5772156649015329


def _ordered(*by: str) -> Window:
    return Window.partitionBy(*(by or ("series",))).orderBy("ts")


def array_quantile(values: Column, share: float) -> Column:
    """Linear interpolation between the order statistics of a sorted array without nulls."""
    place = (F.size(values) - 1) * F.lit(share)
    low = F.floor(place).cast("int")
    a, b = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
    return a + (b - a) * (place - low)


def _window_values(bars: DataFrame, length: int) -> DataFrame:
    frame = _ordered().rowsBetween(-(length - 1), 0)
    return bars.select("series", "ts", F.sort_array(F.collect_list("close").over(frame)).alias("values")).filter(F.size("values") >= length)


def rolling_quantiles(bars: DataFrame, length: int = 20, coverage: float = 0.5) -> DataFrame:
    """Median of the last closes and the band that holds the given share of them."""
    v = F.col("values")
    return _window_values(bars, length).select("series", "ts", array_quantile(v, (1 - coverage) / 2).alias("lower"), array_quantile(v, 0.5).alias("median"), array_quantile(v, (1 + coverage) / 2).alias("upper"))


def robust_band(bars: DataFrame, length: int = 20, k: float = 3.0) -> DataFrame:
    """Median and scaled median absolute deviation of the last closes, and the band of `k` deviations."""
    out = _window_values(bars, length).withColumn("median", array_quantile(F.col("values"), 0.5))
    out = out.withColumn("mad", MAD_SCALE * array_quantile(F.sort_array(F.transform("values", lambda x: F.abs(x - F.col("median")))), 0.5))
    return out.select("series", "ts", "median", "mad", (F.col("median") + k * F.col("mad")).alias("upper"), (F.col("median") - k * F.col("mad")).alias("lower"))


def nearest_rank(bars: DataFrame, share: float = 0.9) -> DataFrame:
    """The close at the rounded rank (n - 1) * share of each series, without interpolation."""
    ranked = bars.select("series", "close", F.row_number().over(Window.partitionBy("series").orderBy("close")).alias("k"), F.count(F.lit(1)).over(Window.partitionBy("series")).alias("n"))
    return ranked.filter(F.col("k") == F.floor((F.col("n") - 1) * share + 0.5) + 1).select("series", F.col("close").alias("value"))


def simple_returns(bars: DataFrame) -> DataFrame:
    """(series, ts, x)"""
    return bars.select("series", "ts", (F.col("close") / F.lag("close").over(_ordered()) - 1).alias("x")).filter("x is not null")


def _blocks(values: DataFrame, seconds: int) -> DataFrame:
    """(series, block, s, c, mean, n): sum and count of each block of time, with the series' mean and count."""
    block = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds)
    sums = values.groupBy("series", block.alias("block")).agg(F.sum("x").alias("s"), F.count("x").alias("c"))
    whole = sums.groupBy("series").agg(F.sum("s").alias("total"), F.sum("c").alias("n"))
    return sums.join(whole, "series").withColumn("mean", F.col("total") / F.col("n")).drop("total")


def block_mean(values: DataFrame, seconds: int = 86400) -> DataFrame:
    """Mean of each series and its standard error with the observations of one block of time as one cluster."""
    off = F.col("s") - F.col("c") * F.col("mean")
    out = _blocks(values, seconds).groupBy("series").agg(F.first("mean").alias("mean"), F.first("n").alias("n"), F.count(F.lit(1)).alias("blocks"), F.sum(off * off).alias("square"))
    error = F.when(F.col("blocks") >= 2, F.sqrt("square") / F.col("n") * F.sqrt(F.col("blocks") / (F.col("blocks") - 1)))
    return out.select("series", "mean", error.alias("std_error"), "blocks")


def block_difference(values: DataFrame, seconds: int = 86400) -> DataFrame:
    """Difference of the means of each two series (a < b) and its clustered standard error over common blocks of time."""
    part = _blocks(values, seconds).select("series", "block", "mean", ((F.col("s") - F.col("c") * F.col("mean")) / F.col("n")).alias("off"))
    means = part.select("series", "mean").distinct()
    pairs = means.select(F.col("series").alias("a"), F.col("mean").alias("ma")).join(means.select(F.col("series").alias("b"), F.col("mean").alias("mb")), F.col("a") < F.col("b"))
    signed = pairs.join(part.select(F.col("series").alias("a"), "block", "off"), "a").select("a", "b", "ma", "mb", "block", "off").unionByName(
        pairs.join(part.select(F.col("series").alias("b"), "block", (-F.col("off")).alias("off")), "b").select("a", "b", "ma", "mb", "block", "off")
    )
    sums = signed.groupBy("a", "b", "ma", "mb", "block").agg(F.sum("off").alias("s"))
    out = sums.groupBy("a", "b", "ma", "mb").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.col("s") * F.col("s")).alias("square"))
    return out.select("a", "b", (F.col("ma") - F.col("mb")).alias("difference"), F.when(F.col("blocks") >= 2, F.sqrt(F.col("square") * F.col("blocks") / (F.col("blocks") - 1))).alias("std_error"))


def luckiest_sharpe(trials: int, variance: float) -> float:
    """The Sharpe ratio that the best of so many trials without skill is expected to show."""
    if trials <= 1:
        return 0.0
    quantile = NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - EULER) * quantile(1 - 1 / trials) + EULER * quantile(1 - 1 / (trials * math.e)))


def deflated_sharpe(values: DataFrame, trials: int = 20, variance: float = 0.0004) -> DataFrame:
    """Sharpe ratio of each series and the probability that it beats the luckiest of the trials, by length and moments."""
    m = values.groupBy("series").agg(F.count("x").alias("observations"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("dev"), F.skewness("x").alias("skew"), (F.kurtosis("x") + 3).alias("kurt"))
    m = m.filter("observations >= 3 and dev > 0").withColumn("sharpe", F.col("mean") / F.col("dev"))
    root = 1 - F.col("skew") * F.col("sharpe") + (F.col("kurt") - 1) / 4 * F.col("sharpe") * F.col("sharpe")
    z = (F.col("sharpe") - luckiest_sharpe(trials, variance)) * F.sqrt(F.col("observations") - 1) / F.sqrt(root)
    return m.filter(root > 0).select("series", "observations", "sharpe", F.lit(luckiest_sharpe(trials, variance)).alias("expected_max_sharpe"), normal_cdf(z).alias("probability"))


def trade_stats(trades: DataFrame, *by: str) -> DataFrame:
    """Of trades (ts, r and the columns `by`): count, win rate, profit factor, expectancy and the deepest fall of the running sum.

    Values that are not finite count as zero. Without losses the profit factor is infinite, without gains and losses zero.
    """
    clean = trades.withColumn("r", F.when(F.col("r").isNull() | F.isnan("r") | (F.abs("r") == float("inf")), 0.0).otherwise(F.col("r")))
    running = _ordered(*by).rowsBetween(Window.unboundedPreceding, 0)
    path = clean.withColumn("equity", F.sum("r").over(running))
    path = path.withColumn("fall", F.greatest(F.lit(0.0), F.max("equity").over(running)) - F.col("equity"))
    out = path.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("r") > 0).cast("double")).alias("win_rate"),
        F.sum(F.greatest(F.col("r"), F.lit(0.0))).alias("gain"),
        F.sum(F.greatest(-F.col("r"), F.lit(0.0))).alias("loss"),
        F.avg("r").alias("expectancy"),
        F.max("fall").alias("max_drawdown"),
    )
    factor = F.when(F.col("loss") > 0, F.col("gain") / F.col("loss")).when(F.col("gain") > 0, float("inf")).otherwise(0.0)
    return out.select(*by, "n", "win_rate", factor.alias("profit_factor"), "expectancy", "max_drawdown")


def outcome_stats(values: DataFrame, *by: str) -> DataFrame:
    """Counts, wins and sums of results x, null ones closed but not won and not in the mean; sums of disjoint parts add up."""
    out = values.groupBy(*by).agg(F.count(F.lit(1)).alias("closed"), F.count_if(F.col("x") > 0).alias("wins"), F.count("x").alias("present"), F.coalesce(F.sum("x"), F.lit(0.0)).alias("total"))
    return out.select(*by, "closed", "wins", (F.col("wins") / F.col("closed")).alias("win_rate"), F.when(F.col("present") > 0, F.col("total") / F.col("present")).otherwise(0.0).alias("mean"), "total")


def band_coverage(bars: DataFrame, length: int = 20, coverage: float = 0.8) -> DataFrame:
    """How often the next close lies in the band that held the given share of the last ones."""
    band = rolling_quantiles(bars, length, coverage)
    after = bars.select("series", "ts", F.lead("close").over(_ordered()).alias("after"))
    return band.join(after, ["series", "ts"]).filter("after is not null").groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("after").between(F.col("lower"), F.col("upper")).cast("double")).alias("share"))


def last_bars(bars: DataFrame) -> DataFrame:
    return bars.groupBy("series").agg(F.max_by("close", "ts").alias("close"))


def round_levels(prices: DataFrame, increment: float = 10.0, each_side: int = 3) -> DataFrame:
    """Multiples of the increment around `close`: so many on either side and the two it lies between."""
    base = F.floor(F.col("close") / increment)
    return prices.select("series", F.explode(F.sequence(base - each_side, base + each_side + 1)).alias("k")).select("series", (F.col("k") * increment).alias("level"))


def fibonacci_levels(bars: DataFrame, length: int = 50) -> DataFrame:
    """Levels of the swing between the last bars' extremes, drawn back from the one that came last."""
    recent = bars.withColumn("k", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("ts")))).filter(F.col("k") <= length)
    swing = recent.groupBy("series").agg(F.max("high").alias("top"), F.min("low").alias("bottom"), F.max_by("k", F.struct("high", "k")).alias("top_age"), F.min_by("k", F.struct("low", "k")).alias("bottom_age"))
    rising, size = F.col("top_age") < F.col("bottom_age"), F.col("top") - F.col("bottom")
    each = swing.withColumn("ratio", F.explode(F.array(*map(F.lit, FIBONACCI))))
    return each.select("series", "ratio", F.when(rising, F.col("top") - size * F.col("ratio")).otherwise(F.col("bottom") + size * F.col("ratio")).alias("level"))


def purged_split(trades: DataFrame, train: tuple[int, int], test: tuple[int, int], embargo: int = 0) -> DataFrame:
    """Trades (first, last, in bars) of both periods with their part: train, test, or purged (open when the test begins)."""
    if train[1] <= train[0] or test[1] <= test[0] or test[0] < train[1]:
        raise ValueError("periods must be ranges in order")
    if test[0] - train[1] < embargo:
        raise ValueError("the gap between the periods is shorter than the embargo")
    begins = lambda period: (F.col("first") >= period[0]) & (F.col("first") < period[1])
    part = F.when(begins(train), F.when(F.col("last") >= test[0], "purged").otherwise("train")).when(begins(test), "test")
    return trades.withColumn("part", part).filter("part is not null")
