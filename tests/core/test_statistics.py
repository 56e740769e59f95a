import math
from datetime import datetime, timedelta
from statistics import NormalDist

import numpy as np
import pytest

from pyspark.sql import functions as F
from tidemark.functions import finance
from tidemark.plans import statistics as S


def test_normal_distribution_has_double_accuracy(spark):
    xs = [k / 16 for k in range(-160, 161)] + [-40.0, 40.0, 7.0710678, -7.0710679]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", finance.normal_cdf(F.col("x")).alias("p")).collect()
    assert all(abs(r.p - NormalDist().cdf(r.x)) < 1e-14 for r in got)


def test_options_keep_put_call_parity(spark):
    df = spark.createDataFrame([(100.0, k, v) for k in (60.0, 100.0, 150.0) for v in (0.1, 0.4)], "s double, k double, v double")
    call, put = finance.option_value(F.col("s"), F.col("k"), 0.03, 0.03, F.col("v"), F.lit(0.5))
    for r in df.select("s", "k", "v", call.alias("c"), put.alias("p")).collect():
        d1 = (math.log(r.s / r.k) + (0.03 + r.v**2 / 2) * 0.5) / (r.v * math.sqrt(0.5))
        want = r.s * NormalDist().cdf(d1) - r.k * math.exp(-0.015) * NormalDist().cdf(d1 - r.v * math.sqrt(0.5))
        assert abs(r.c - want) < 1e-11 and abs(r.c - r.p - (r.s - r.k * math.exp(-0.015))) < 1e-11


def test_deflated_sharpe(spark):
    r = np.random.default_rng(3)
    x = r.standard_t(5, 400) * 0.01 + 0.001
    rows = [("a", datetime(2024, 1, 1) + timedelta(hours=k), float(v)) for k, v in enumerate(x)]
    got = S.deflated_sharpe(spark.createDataFrame(rows, "series string, ts timestamp_ntz, x double"), 50, 0.002).first()
    m2, m3, m4 = (((x - x.mean()) ** k).mean() for k in (2, 3, 4))
    sharpe = x.mean() / x.std(ddof=1)
    best = math.sqrt(0.002) * (0.4227843350984671 * NormalDist().inv_cdf(0.98) + 0.5772156649015329 * NormalDist().inv_cdf(1 - 1 / (50 * math.e)))
    z = (sharpe - best) * math.sqrt(399) / math.sqrt(1 - m3 / m2**1.5 * sharpe + (m4 / m2**2 - 1) / 4 * sharpe**2)
    assert got.observations == 400 and abs(got.sharpe - sharpe) < 1e-12 and abs(got.probability - NormalDist().cdf(z)) < 1e-10


def test_trade_stats_by_hand(spark):
    t = lambda k: datetime(2024, 1, 1, k)
    rows = [("a", t(0), 2.0), ("a", t(1), -1.0), ("a", t(2), -3.0), ("a", t(3), 1.0), ("b", t(0), 1.0), ("b", t(1), math.nan), ("c", t(0), -2.0)]
    got = {r.k: r for r in S.trade_stats(spark.createDataFrame(rows, "k string, ts timestamp_ntz, r double"), "k").collect()}
    assert (got["a"].n, got["a"].win_rate, got["a"].profit_factor, got["a"].expectancy, got["a"].max_drawdown) == (4, 0.5, 0.75, -0.25, 4.0)
    assert got["b"].profit_factor == math.inf and got["b"].n == 2 and got["c"].max_drawdown == 2.0 and got["c"].profit_factor == 0.0
    with pytest.raises(ValueError):
        S.purged_split(spark.createDataFrame([(1, 2)], "first long, last long"), (0, 10), (12, 20), embargo=5)


def test_rows_functions(spark):
    got = spark.range(1).select(
        finance.volatility_scale(F.lit(0.1), 0.2, 1.5).alias("a"), finance.volatility_scale(F.lit(0.0), 0.2, 1.5).alias("b"),
        finance.period_return(F.lit(100.0), F.lit(150.0), F.lit(50.0), 0.5).alias("c"), finance.period_return(F.lit(0.0), F.lit(1.0), F.lit(0.0), 0.5).alias("d"),
        finance.range_distance(F.lit(10.0), F.lit(7.0), F.lit(2.0)).alias("e"), finance.range_distance(F.lit(10.0), F.lit(7.0), F.lit(0.0)).alias("f"),
    ).first()
    assert tuple(got) == (1.5, 1.0, 0.0, None, 1.5, None)
