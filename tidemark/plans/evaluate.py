"""Forward-looking evaluation: moves, first passage, signal outcomes, calibration, survival of phases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .crosssection import wilson

def _ordered():
    return Window.partitionBy("series").orderBy("ts")


def forward_move(bars: DataFrame, horizon: int = 10) -> DataFrame:
    """From each close: the return, best and worst excursion over the next `horizon` bars; NULL where fewer follow."""
    ahead = _ordered().rowsBetween(1, horizon)
    full = F.count(F.lit(1)).over(ahead) == horizon
    return bars.select(
        "series", "ts",
        F.when(full, F.lead("close", horizon).over(_ordered()) / F.col("close") - 1).alias("ret"),
        F.when(full, F.max("high").over(ahead) / F.col("close") - 1).alias("best"),
        F.when(full, F.min("low").over(ahead) / F.col("close") - 1).alias("worst"),
    )


def first_passage(bars: DataFrame, up: float = 0.5, down: float = 0.5, horizon: int = 10) -> DataFrame:
    """Which of two levels around each close the next bars reach first, and when; both in one bar counts as the lower.

    One frame of at most `horizon` rows is searched for each bar, so the cost is rows x horizon whatever the series' length.
    """
    ahead = F.collect_list(F.struct("high", "low")).over(_ordered().rowsBetween(1, horizon))
    rows = bars.select("series", "ts", (F.col("close") * (1 + up)).alias("upper"), (F.col("close") * (1 - down)).alias("lower"), ahead.alias("a"))
    at = rows.withColumn("k", F.array_min(F.transform("a", lambda x, i: F.when((x["high"] >= F.col("upper")) | (x["low"] <= F.col("lower")), i + 1))))
    side = F.when(F.col("k").isNull(), "none").when(F.element_at("a", F.col("k").cast("int"))["low"] <= F.col("lower"), "lower").otherwise("upper")
    return at.select("series", "ts", side.alias("side"), F.col("k").cast("long").alias("bars"))


def passage_summary(passages: DataFrame) -> DataFrame:
    """For each series: counts by side, the share of upper hits with its Wilson interval, and mean bars to a hit."""
    n = passages.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("side") == "upper").cast("long")).alias("upper"), F.sum((F.col("side") == "lower").cast("long")).alias("lower"), F.avg("bars").alias("mean_bars"))
    low, high = wilson(F.col("upper"), F.col("n"))
    return n.withColumns({"share": F.col("upper") / F.col("n"), "share_low": low, "share_high": high})


def cross_signals(bars: DataFrame, fast: int = 5, slow: int = 20) -> DataFrame:
    """Rows where the fast mean crosses the slow one, with direction 1 or -1."""
    mean = lambda n: F.avg("close").over(_ordered().rowsBetween(-(n - 1), 0))
    m = bars.select("series", "ts", "close", (mean(fast) - mean(slow)).alias("gap"), F.row_number().over(_ordered()).alias("i")).withColumn("before", F.lag("gap").over(_ordered()))
    side = F.when((F.col("before") <= 0) & (F.col("gap") > 0), 1).when((F.col("before") >= 0) & (F.col("gap") < 0), -1)
    return m.filter(F.col("i") > slow).withColumn("direction", side).filter("direction is not null").select("series", "ts", "close", "direction")


def signal_outcomes(bars: DataFrame, horizon: int = 10) -> DataFrame:
    """For each series and direction of crossing signals: count, hit rate and mean signed return over the horizon."""
    signals = cross_signals(bars).select("series", "ts", "direction")
    joined = signals.join(forward_move(bars, horizon), ["series", "ts"]).filter("ret is not null").withColumn("signed", F.col("ret") * F.col("direction"))
    return joined.groupBy("series", "direction").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("signed") > 0).cast("double")).alias("hit_rate"), F.avg("signed").alias("mean"))


def calibration(bars: DataFrame, buckets: int = 5, horizon: int = 5) -> DataFrame:
    """Reliability table: the percentile of the close in its last 20 bars as a forecast of a rise, by bucket."""
    w20 = _ordered().rowsBetween(-19, 0)
    score = (F.col("close") - F.min("low").over(w20)) / (F.max("high").over(w20) - F.min("low").over(w20))
    rows = bars.select("series", "ts", score.alias("p"), F.row_number().over(_ordered()).alias("i"), (F.lead("close", horizon).over(_ordered()) > F.col("close")).alias("rose")).filter("i >= 20 and rose is not null")
    bucket = F.least(F.floor(F.col("p") * buckets), F.lit(buckets - 1)).cast("int")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("forecast"), F.avg(F.col("rose").cast("double")).alias("rate"), F.avg((F.col("p") - F.col("rose").cast("double")) * (F.col("p") - F.col("rose").cast("double"))).alias("brier"))


def phase_survival(bars: DataFrame) -> DataFrame:
    """Kaplan-Meier survival of runs above or below the 20-bar mean; each series' last run is censored."""
    mean = F.avg("close").over(_ordered().rowsBetween(-19, 0))
    side = bars.select("series", "ts", (F.col("close") > mean).alias("above"), F.row_number().over(_ordered()).alias("i")).filter("i >= 20")
    edge = side.withColumn("turn", F.coalesce((F.col("above") != F.lag("above").over(_ordered())).cast("int"), F.lit(1)))
    runs = edge.withColumn("run", F.sum("turn").over(_ordered().rowsBetween(Window.unboundedPreceding, 0))).groupBy("series", "run").agg(F.count(F.lit(1)).alias("age"))
    last = runs.withColumn("ended", (F.col("run") < F.max("run").over(Window.partitionBy("series"))).cast("long"))
    table = last.groupBy("age").agg(F.sum("ended").alias("ends"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("age")).rowsBetween(Window.unboundedPreceding, 0)  # one row for each age at most
    at_risk = table.withColumn("at_risk", F.sum("n").over(w))
    up = Window.orderBy("age").rowsBetween(Window.unboundedPreceding, 0)
    keep = F.when(F.col("ends") == F.col("at_risk"), 0.0).otherwise(F.exp(F.sum(F.log(F.when(F.col("ends") < F.col("at_risk"), 1 - F.col("ends") / F.col("at_risk")))).over(up)))
    return at_risk.select("age", "ends", "at_risk", keep.alias("survival"))


def calibration_chunks(records: DataFrame, buckets: int = 10) -> DataFrame:
    """(chunk, forecast, win_rate, n): records (p, won) in order of forecast, cut into chunks of ceil(n / buckets).

    Equal forecasts are one row of counts first, spread over the chunks they reach into with their own win rate, so the
    result does not hang on the order of ties and no task sorts single records.
    """
    same = records.filter("p IS NOT NULL AND won IS NOT NULL").groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("won").cast("double")).alias("wins"))
    total = same.agg(F.sum("n")).first()[0] or 0
    size = max(1, -(-total // max(1, min(buckets, total or 1))))
    upto = F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0))  # one row for each different forecast
    placed = same.withColumn("z", upto).withColumn("a", F.col("z") - F.col("n"))
    parts = placed.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("a") / size), F.floor((F.col("z") - 1) / size))))
    part = F.least(F.col("z"), (F.col("chunk") + 1) * size) - F.greatest(F.col("a"), F.col("chunk") * size)
    parts = parts.withColumn("part", part)
    return parts.groupBy("chunk").agg((F.sum(F.col("p") * F.col("part")) / F.sum("part")).alias("forecast"), (F.sum(F.col("wins") / F.col("n") * F.col("part")) / F.sum("part")).alias("win_rate"), F.sum("part").alias("n"))


def calibration_metrics(records: DataFrame, baseline: float, bins: int = 10) -> DataFrame:
    """brier, baseline_brier, skill, log_loss, ece and n of records (p, won) against a constant forecast; no row for none."""
    b = min(max(baseline, 1e-6), 1 - 1e-6)
    y = F.col("won").cast("double")
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), "p"))
    flat = F.greatest(F.lit(0.0), F.least(F.lit(1.0), "p"))
    rows = records.filter("p IS NOT NULL AND won IS NOT NULL").select(F.least(F.floor(flat * bins), F.lit(bins - 1)).alias("bin"), F.pow(p - y, 2).alias("e"), F.pow(b - y, 2).alias("e0"), (-F.log(F.when(F.col("won"), p).otherwise(1 - p))).alias("l"), flat.alias("f"), y.alias("y"))
    each = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("e", "e0", "l", "f", "y")])
    n = F.sum("n")
    brier, base = F.sum("e") / n, F.sum("e0") / n
    return each.agg(brier.alias("brier"), base.alias("baseline_brier"), F.when(base > 1e-12, 1 - brier / base).otherwise(0.0).alias("skill"), (F.sum("l") / n).alias("log_loss"), (F.sum(F.abs(F.col("f") - F.col("y"))) / n).alias("ece"), n.alias("n")).filter("n IS NOT NULL")
