"""Probability models fitted by Spark sums: isotonic calibration by pooling, logistic regression by Newton steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stop once no coefficient moves by as much, or after so many steps.
TOLERANCE, STEPS = 1e-10, 100


def rank_forecasts(bars: DataFrame, horizon: int = 5) -> DataFrame:
    """(series, ts, p, trend, activity, rose): place of the close in its last 20 bars, its last change, its share of their
    volume, and whether it is higher `horizon` bars on."""
    w = Window.partitionBy("series").orderBy("ts")
    last = w.rowsBetween(-19, 0)
    span = F.max("high").over(last) - F.min("low").over(last)
    p = F.when(span > 0, (F.col("close") - F.min("low").over(last)) / span).otherwise(0.5)
    rows = bars.select("series", "ts", p.alias("p"), (F.col("close") / F.lag("close").over(w) - 1).alias("trend"), (F.col("volume") / F.sum("volume").over(last)).alias("activity"), (F.lead("close", horizon).over(w) > F.col("close")).alias("rose"), F.row_number().over(w).alias("i"))
    return rows.filter("i >= 20 AND rose IS NOT NULL").drop("i")


def _pool(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pools ascending blocks while one's rate lies below its predecessor's; rates are compared as whole counts."""
    low: list[float] = []
    high: list[float] = []
    n: list[int] = []
    won: list[int] = []
    for frame in frames:
        for a, b, m, y in zip(frame["low"], frame["high"], frame["n"].tolist(), frame["won"].tolist(), strict=True):
            while n and y * n[-1] < won[-1] * m:
                a, m, y = low.pop(), m + n.pop(), y + won.pop()
                high.pop()
            low.append(a)
            high.append(b)
            n.append(m)
            won.append(y)
    if n:
        yield pd.DataFrame({"low": low, "high": high, "n": n, "won": won})


def fit_isotonic(samples: DataFrame) -> DataFrame:
    """Blocks (low, high, n, won, value) of the non-decreasing fit to samples (score, won); value = won / n.

    Equal scores are one block from the start. Each range of scores is pooled by itself, then what is left of all ranges
    together: the rates of m yes-no samples form at most about m^(2/3) rising blocks, so the last step is small. Null and NaN
    scores and null outcomes are left out.
    """
    shape = "low double, high double, n long, won long"
    known = samples.filter("score IS NOT NULL AND NOT isnan(score) AND won IS NOT NULL")
    scores = known.groupBy((F.col("score") + 0.0).alias("low")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("won").cast("long")).alias("won"))
    parts = scores.select("low", F.col("low").alias("high"), "n", "won").repartitionByRange("low").sortWithinPartitions("low").mapInPandas(_pool, shape)
    return parts.repartition(1).sortWithinPartitions("low").mapInPandas(_pool, shape).withColumn("value", F.col("won") / F.col("n"))


def predict_isotonic(blocks: DataFrame, rows: DataFrame, score: str = "score") -> DataFrame:
    """`rows` with `calibrated`: flat inside a block, straight lines between blocks, the end values beyond; 0.5 without blocks.

    The blocks of a fit, few by its bound, go to the tasks as arrays. A null or NaN score stays null.
    """
    fitted = blocks.orderBy("low").toPandas()
    x = np.unique(np.concatenate([fitted["low"], fitted["high"]]).astype(float))
    y = fitted["value"].to_numpy(float)[np.searchsorted(fitted["low"].to_numpy(float), x, "right") - 1] if len(fitted) else np.array([])

    @F.pandas_udf("double")
    def curve(s: pd.Series) -> pd.Series:
        return pd.Series(np.where(s.isna(), np.nan, np.interp(s.to_numpy(float), x, y) if len(x) else 0.5)).where(~s.isna().to_numpy())

    return rows.withColumn("calibrated", curve(F.col(score).cast("double")))


def fit_logistic(rows: DataFrame, features: list[str], label: str, l2: float = 0.0) -> dict | None:
    """intercept, weights and Newton steps of a logistic model with a penalty l2 / 2 on the squared weights.

    Each step is one pass that adds up gradient and Hessian; only these (features + 1)^2 sums reach the driver. None for no
    rows, a negative l2 or a singular system. Rows with a null feature or label are left out.
    """
    if not l2 >= 0:
        return None
    x = [F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in features]]
    names = [f"x{k}" for k in range(len(x))]
    known = rows.select(*[c.alias(n) for c, n in zip(x, names, strict=True)], F.col(f"`{label}`").cast("double").alias("y")).dropna().persist(StorageLevel.MEMORY_AND_DISK)
    try:
        beta, penalty = np.zeros(len(x)), np.diag([0.0, *[l2] * len(features)])
        pairs = [(a, b) for a in range(len(x)) for b in range(a, len(x))]
        for step in range(1, STEPS + 1):
            p = logistic(dict(zip(names, beta.tolist(), strict=True)))
            sized = known.withColumn("p", p).withColumn("w", F.col("p") * (1 - F.col("p")))
            sums = sized.agg(*[F.sum((F.col("y") - F.col("p")) * F.col(n)) for n in names], *[F.sum(F.col("w") * F.col(names[a]) * F.col(names[b])) for a, b in pairs]).first()
            if sums[0] is None:
                return None
            hessian = np.zeros((len(x), len(x)))
            for (a, b), value in zip(pairs, sums[len(x) :], strict=True):
                hessian[a, b] = hessian[b, a] = value
            try:
                move = np.linalg.solve(hessian + penalty, np.array(sums[: len(x)]) - penalty @ beta)
            except np.linalg.LinAlgError:
                return None
            if not np.isfinite(move).all():
                return None
            beta += move
            if np.abs(move).max() < TOLERANCE:
                break
        return {"intercept": float(beta[0]), "weights": dict(zip(features, beta[1:].tolist(), strict=True)), "steps": step}
    finally:
        known.unpersist()


def logistic(terms: dict[str, float], intercept: float = 0.0) -> Column:
    """The probability at columns with these weights, without overflow on either side."""
    z = F.lit(intercept)
    for name, weight in terms.items():
        z = z + F.col(f"`{name}`") * F.lit(weight)
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))
