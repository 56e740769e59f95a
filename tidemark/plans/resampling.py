"""Block bootstraps as tables: seeded blocks joined with running sums, so no resampled path is ever built row by row.

A path is a list of blocks (path, step, start, length) over the circle of n positions. The sum of a block is the difference of
two running sums, so a statistic of R paths over n positions costs two look-ups for each block and series, not R x n rows.
Blocks come from seeded generators in tasks; only counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WORD = 1 << 64
#: Constants of two published generators: SplitMix64, and the multiplier of a 64-bit linear congruence with its usual increment.
_GOLDEN, _MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_FACTOR, PATH_STEP = 6364136223846793005, 1442695040888963407
#: Positions that one window of a running sum holds.
_SPAN = 1 << 14


def running_sums(values: DataFrame, by: str) -> DataFrame:
    """(by, at, total): the sum of `value` over the first `at` positions (`pos` from 0) of each series, `at` from 0.

    Spans of positions are summed first and carried over, so no window holds a whole series.
    """
    span = values.withColumn("span", F.floor(F.col("pos") / _SPAN))
    carried = span.groupBy(by, "span").agg(F.sum("value").alias("own"))
    before = Window.partitionBy(by).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(by, "span", F.coalesce(F.sum("own").over(before), F.lit(0.0)).alias("carried"))
    inside = Window.partitionBy(by, "span").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = span.join(carried, [by, "span"]).select(by, (F.col("pos") + 1).alias("at"), (F.col("carried") + F.sum("value").over(inside)).alias("total"))
    return sums.union(values.select(by).distinct().select(by, F.lit(0).cast("long").alias("at"), F.lit(0.0).alias("total")))


def block_means(blocks: DataFrame, values: DataFrame, n: int, by: str) -> DataFrame:
    """(path, by, mean) of each path of n steps; no block is longer than n."""
    twice = values.select(by, "pos", "value").union(values.select(by, F.col("pos") + n, "value"))  # the circle laid out twice
    sums = running_sums(twice, by)
    ends = blocks.select("path", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(-1.0).alias("sign")), F.struct((F.col("start") + F.col("length")).alias("at"), F.lit(1.0).alias("sign")))).alias("e")).select("path", "e.at", "e.sign")
    return ends.join(sums, "at").groupBy("path", by).agg((F.sum(F.col("sign") * F.col("total")) / n).alias("mean"))


def _uniforms(seed: int, first: int, count: int) -> np.ndarray:
    """Draws first, first + 1, ... of the SplitMix64 stream, each of 53 bits in [0, 1)."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed % _WORD) + np.uint64(_GOLDEN) * np.arange(first + 1, first + count + 1, dtype=np.uint64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(_MIX[0])
        z = (z ^ (z >> np.uint64(27))) * np.uint64(_MIX[1])
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def stationary_blocks(spark: SparkSession, n: int, paths: int, mean_block: float, seed: int) -> DataFrame:
    """Blocks of geometric length from one stream of draws: a draw for a start, then one before each further step, which
    breaks the block if below 1 / mean_block. One task reads the stream and passes blocks on as it goes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _ in range(len(frame)):
                path, done, at = 0, 0, 0
                while path < paths:
                    first, size = at, 1 << 18
                    draws = _uniforms(seed, first, size)
                    breaks = np.flatnonzero(draws < 1.0 / mean_block) + first
                    out = []
                    while path < paths:
                        k = np.searchsorted(breaks, at + 1)
                        broken = int(breaks[k]) if k < len(breaks) else None
                        left = n - done
                        if broken is None and at + left > first + size:
                            if at == first:  # a block longer than what is held: hold more
                                size *= 4
                                draws = _uniforms(seed, first, size)
                                breaks = np.flatnonzero(draws < 1.0 / mean_block) + first
                                continue
                            break
                        length = left if broken is None else min(left, broken - at)
                        out.append((path, min(int(draws[at - first] * n), n - 1), length))
                        if length == left:
                            path, done, at = path + 1, 0, at + length
                        else:
                            done, at = done + length, at + length + 1
                        if at >= first + size:
                            break
                    yield pd.DataFrame(out, columns=["path", "start", "length"])

    return spark.range(1, numPartitions=1).mapInPandas(run, "path long, start long, length long").repartition("path")


def _jump(state: int, steps: int, add: int) -> int:
    """The congruence's state after so many steps."""
    factor, shift = _FACTOR, add
    while steps:
        if steps & 1:
            state = (state * factor + shift) % _WORD
        factor, shift, steps = factor * factor % _WORD, (factor + 1) * shift % _WORD, steps >> 1
    return state


def circular_blocks(spark: SparkSession, n: int, steps: int, block: int, paths: int, seed: int, add: int) -> DataFrame:
    """(path, step, start, length): each path has ceil(steps / block) blocks, the last cut short. Paths are drawn in parallel
    from one stream, each task jumping to its place in it."""
    each = -(-steps // block)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["id"]:
                state, out = _jump((seed + 1) % _WORD, int(path) * each, add), []
                for k in range(each):
                    state = (state * _FACTOR + add) % _WORD
                    out.append((path, k * block, state % n, min(block, steps - k * block)))
                yield pd.DataFrame(out, columns=["path", "step", "start", "length"])

    return spark.range(paths).mapInPandas(run, "path long, step long, start long, length long")


def numbered(rows: DataFrame, by: str, order: str = "ts") -> DataFrame:
    """`rows` with `pos`, their place (from 0) within each series."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy(order)).cast("long") - 1)


def _extent(values: DataFrame, by: str):
    each = values.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("known"), F.max("pos").alias("last"))
    return each.agg(F.min("n").alias("low"), F.max("n").alias("n"), F.min("known").alias("known"), F.max("last").alias("last"), F.count(F.lit(1)).alias("k")).first()


def data_snooping(excess: DataFrame, mean_block: float = 10.0, resamples: int = 2000, seed: int = 0x5EED0F5AA0) -> DataFrame:
    """best, best_mean, p_reality_check, p_spa of rules with excess returns (rule, pos, value).

    White's Reality Check and Hansen's consistent test of superior predictive ability, on stationary bootstrap means. No row
    if rules differ in length, have gaps or fewer than two periods, or a parameter is out of range.
    """
    spark = excess.sparkSession
    e = _extent(excess, "rule")
    fine = e["k"] and e["low"] == e["n"] == e["known"] == e["last"] + 1 and e["n"] >= 2 and mean_block >= 1 and resamples > 0
    n = e["n"] if fine else 2
    root, bar = float(n) ** 0.5, (2 * np.log(np.log(n))) ** 0.5 if n >= 3 else 0.0
    blocks = stationary_blocks(spark, n, resamples, mean_block, seed)
    means = excess.groupBy("rule").agg(F.avg("value").alias("own"))
    boot = block_means(blocks, excess, n, "rule").join(means, "rule").withColumn("off", root * (F.col("mean") - F.col("own")))
    spread = boot.groupBy("rule").agg(F.sqrt(F.avg(F.col("off") * F.col("off"))).alias("omega"))
    rules = means.join(spread, "rule").withColumn("live", F.col("omega") > 1e-12 * F.abs("own"))  # running sums round: a constant rule has no spread
    rules = rules.withColumn("t", F.when(F.col("live"), root * F.col("own") / F.col("omega"))).withColumn("mu", F.when(F.col("t") >= -bar, F.col("own")).otherwise(0.0))
    tops = rules.agg(F.min_by("rule", F.struct(-F.col("own"), "rule")).alias("best"), F.max("own").alias("best_mean"), F.greatest(F.lit(0.0), F.coalesce(F.max("t"), F.lit(0.0))).alias("spa"))
    drawn = boot.join(rules.select("rule", "omega", "mu", "live"), "rule")
    paths = drawn.groupBy("path").agg(F.max("off").alias("rc"), F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(F.col("live"), root * (F.col("mean") - F.col("mu")) / F.col("omega"))), F.lit(0.0))).alias("spa"))
    top = tops.first() if fine else None
    if top is None:
        return spark.createDataFrame([], f"best {dict(excess.dtypes)['rule']}, best_mean double, p_reality_check double, p_spa double")
    share = lambda hit: F.avg(hit.cast("double"))
    return paths.agg(F.lit(top["best"]).alias("best"), F.lit(top["best_mean"]).alias("best_mean"), share(F.col("rc") >= root * top["best_mean"]).alias("p_reality_check"), share(F.col("spa") >= top["spa"]).alias("p_spa"))


def brier_bootstrap(records: DataFrame, block: int, resamples: int, seed: int) -> DataFrame:
    """mean, p05, p95 of the Brier score of forecasts (pos, p, won) over circular block resamples; no row for an empty table."""
    spark = records.sparkSession
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), "p"))
    errors = records.select(F.lit(0).alias("one"), "pos", F.pow(p - F.col("won").cast("double"), 2).alias("value"))
    n = errors.count()
    fine = bool(n and block > 0 and resamples > 0)
    blocks = circular_blocks(spark, max(n, 1), max(n, 1), max(block, 1), resamples if fine else 0, seed, 1)
    scores = block_means(blocks, errors, max(n, 1), "one")
    place = F.row_number().over(Window.partitionBy("one").orderBy("mean")) - 1  # one row for each resample
    at = lambda share: F.max(F.when(F.col("place") == min(int(share * resamples), resamples - 1), F.col("mean")))
    return scores.withColumn("place", place).groupBy("one").agg(F.avg("mean").alias("mean"), at(0.05).alias("p05"), at(0.95).alias("p95")).drop("one")


def path_returns(returns: DataFrame, block: int, steps: int, paths: int, seed: int) -> DataFrame:
    """(path, step, asset, value): joint paths of all assets (asset, pos, value), whose blocks are the same for each asset.

    No row if assets differ in length, have gaps or values that are not finite, or a parameter is not positive.
    """
    spark = returns.sparkSession
    e = _extent(returns.withColumn("value", F.when(F.abs("value") < float("inf"), F.col("value"))), "asset")
    fine = bool(e["k"] and e["low"] == e["n"] == e["known"] == e["last"] + 1 and min(block, steps, paths) > 0)
    n = e["n"] if fine else 1
    blocks = circular_blocks(spark, n, max(steps, 1), max(block, 1), paths if fine else 0, seed, PATH_STEP)
    drawn = blocks.select("path", F.posexplode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("k", "at"), "step")
    drawn = drawn.select("path", (F.col("step") + F.col("k")).alias("step"), F.pmod("at", F.lit(n)).alias("pos"))
    return drawn.join(returns.select("asset", "pos", "value"), "pos").select("path", "step", "asset", "value")
