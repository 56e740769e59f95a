"""Curves and surfaces as rows, calibration by chunks and metrics, against plain versions."""

import datetime as dt
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import curves
from tidemark.plans import evaluate

QUOTES = "curve string, reference date, maturity date, kind string, rate double, frequency int"
DAY = dt.date(2024, 1, 31)


def test_rates_between_and_outside_nodes(spark):
    made = curves.curves(spark.createDataFrame([("a", 2.0, 0.04), ("a", 1.0, 0.02), ("b", 1.0, 0.03), ("c", 1.0, 0.01), ("c", 1.0, 0.02)], "k string, t double, r double"), ["k"])
    assert {r.k for r in made.collect()} == {"a", "b"}
    asked = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 1.0, 1.5, 2.0, 9.0)], "x double").crossJoin(made.filter("k = 'a'"))
    assert [r.r for r in asked.orderBy("x").select(curves.rate_at(F.col("nodes"), F.col("x")).alias("r")).collect()] == [None, 0.02, 0.02, 0.03, 0.04, 0.04]


def test_swap_periods_keep_month_ends(spark):
    row = spark.createDataFrame([(dt.date(2024, 1, 10), dt.date(2025, 2, 28), 2)], "a date, z date, f int")
    periods = row.select(curves.swap_periods(F.col("a"), F.col("z"), F.col("f"), "act/365").alias("p")).first().p
    days = [dt.date(2023, 8, 31), dt.date(2024, 2, 29), dt.date(2024, 8, 31), dt.date(2025, 2, 28)]
    assert [(round(p.t * 365), round(p.accrual * 365)) for p in periods] == [((b - dt.date(2024, 1, 10)).days, (b - a).days) for a, b in zip(days, days[1:], strict=False)]


def test_solved_curves_price_their_quotes(spark):
    rows = [("x", DAY, dt.date(2024, 7, 31), "zero", 0.03, None)]
    rows += [("x", DAY, dt.date(2024 + y, 1, 31), "swap", 0.03 + 0.002 * y, f) for y, f in ((1, 1), (2, 2), (5, 4), (10, 12))]
    bad = [("late", DAY, DAY, "zero", 0.03, None), ("twice", DAY, dt.date(2025, 1, 31), "zero", 0.03, None), ("twice", DAY, dt.date(2025, 1, 31), "swap", 0.03, 1), ("steep", DAY, dt.date(2034, 1, 31), "swap", 90.0, 1), ("nan", DAY, dt.date(2025, 1, 31), "zero", float("nan"), None)]
    df = spark.createDataFrame(rows + bad, QUOTES)
    solved = curves.bootstrap(df)
    assert [r.curve for r in solved.collect()] == ["x"]
    priced = df.filter("kind = 'swap' AND curve = 'x'").join(solved, ["curve", "reference"])
    periods = curves.swap_periods(F.col("reference"), F.col("maturity"), F.col("frequency"), "act/365")
    for r in priced.select("rate", curves.par_rate(F.col("nodes"), periods).alias("par")).collect():
        assert abs(r.rate - r.par) < 1e-10
    assert curves.bootstrap(df.filter(F.lit(False))).collect() == []


def test_surfaces(spark):
    ts, ks = [0.5, 1.0, 2.0], [80.0, 100.0, 130.0]
    draw = random.Random(3)
    grid = [[draw.uniform(0.1, 0.5) for _ in ks] for _ in ts]
    rows = [("a", t, k, grid[i][j]) for i, t in enumerate(ts) for j, k in enumerate(ks)] + [("hole", 1.0, 80.0, 0.2), ("hole", 1.0, 90.0, 0.2), ("hole", 2.0, 80.0, 0.2), ("bad", 1.0, 80.0, -0.2), ("one", 0.0, 1.0, 0.3)]
    made = curves.surfaces(spark.createDataFrame(rows, "k string, t double, strike double, vol double"), ["k"])
    assert {r.k for r in made.collect()} == {"a", "one"}
    points = [(draw.uniform(0, 2.6), draw.uniform(70, 140)) for _ in range(60)] + [(0.5, 80.0), (2.0, 130.0), (-0.1, 100.0), (1.0, 0.0)]
    asked = spark.createDataFrame(points, "y double, s double").crossJoin(made.filter("k = 'a'"))
    for r in asked.select("y", "s", curves.volatility_at(F.col("maturities"), F.col("strikes"), F.col("grid"), F.col("y"), F.col("s")).alias("v")).collect():
        if not (0 <= r.y <= 2.25 and 75 <= r.s <= 135):
            assert r.v is None
            continue
        by_strike = [np.interp(r.s, ks, row) for row in grid]
        assert math.isclose(r.v, np.interp(r.y, ts, by_strike), rel_tol=1e-12)
    flat = spark.createDataFrame([(5.0, 77.0)], "y double, s double").crossJoin(made.filter("k = 'one'"))
    assert flat.select(curves.volatility_at(F.col("maturities"), F.col("strikes"), F.col("grid"), F.col("y"), F.col("s"), float("inf"), float("inf")).alias("v")).first().v in (0.3, None)


def test_calibration_by_chunks_and_metrics(spark):
    draw = random.Random(9)
    rows = [(round(draw.uniform(-0.1, 1.1), 2), draw.random() < 0.5) for _ in range(503)]
    df = spark.createDataFrame([*rows, (None, True), (0.5, None)], "p double, won boolean").repartition(3)
    found = evaluate.calibration_chunks(df, 7).orderBy("chunk").collect()
    size, order = -(-503 // 7), sorted(p for p, _ in rows)
    assert [r.n for r in found] == [len(order[k : k + size]) for k in range(0, 503, size)]
    assert np.allclose([r.forecast for r in found], [np.mean(order[k : k + size]) for k in range(0, 503, size)])
    assert abs(sum(r.win_rate * r.n for r in found) - sum(w for _, w in rows)) < 1e-9
    m = evaluate.calibration_metrics(df, 0.4, 5).first()
    q = np.clip([p for p, _ in rows], 1e-15, 1 - 1e-15)
    y = np.array([w for _, w in rows], float)
    flat = np.clip(q, 0, 1)
    bins = np.minimum((flat * 5).astype(int), 4)
    ece = sum(abs(flat[bins == b].sum() - y[bins == b].sum()) for b in range(5)) / 503
    want = [((q - y) ** 2).mean(), ((0.4 - y) ** 2).mean(), 1 - ((q - y) ** 2).mean() / ((0.4 - y) ** 2).mean(), -np.log(np.where(y == 1, q, 1 - q)).mean(), ece]
    assert np.allclose([m.brier, m.baseline_brier, m.skill, m.log_loss, m.ece], want, rtol=1e-9) and m.n == 503
    none = df.filter(F.lit(False))
    assert evaluate.calibration_chunks(none).collect() == [] == evaluate.calibration_metrics(none, 0.5).collect()
