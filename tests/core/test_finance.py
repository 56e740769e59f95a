"""Schedules, bonds, curves and options against worked values and plain Python."""

import datetime as dt
import math
import subprocess
import sys
from pathlib import Path
from statistics import NormalDist

import pytest

from pyspark.sql import functions as F
from tidemark.functions import contracts, finance

D = dt.date


def _day(d):
    return F.lit(d).cast("date")


def _one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_year_fractions(spark):
    pairs = [(D(2023, 1, 31), D(2023, 7, 31)), (D(2023, 12, 31), D(2025, 3, 1)), (D(2024, 2, 29), D(2024, 2, 29)), (D(2024, 5, 1), D(2020, 2, 29))]
    df = spark.createDataFrame(pairs, "a date, b date")
    f = {c: [r.x for r in df.select(finance.year_fraction(F.col("a"), F.col("b"), c).alias("x")).collect()] for c in finance.DAY_COUNTS}
    assert f["act/360"][0] == pytest.approx(181 / 360) and f["30/360"][0] == pytest.approx(0.5)
    assert f["act/act"][1] == pytest.approx(1 / 365 + 1 + 59 / 365)
    assert all(v[2] == 0 for v in f.values())
    assert f["act/act"][3] == pytest.approx(-(307 / 366 + 3 + 121 / 366))
    with pytest.raises(ValueError):
        finance.year_fraction(F.col("a"), F.col("b"), "act/364")


def test_discounting_at_the_edges(spark):
    r = _one(spark, neg=finance.discount_factor(F.lit(0.05), F.lit(-1.0)), broke=finance.discount_factor(F.lit(-1.5), F.lit(2.0), 1), fine=finance.discount_factor(F.lit(-0.01), F.lit(2.0), 2))
    assert (r.neg, r.broke) == (0.0, 0.0) and r.fine == pytest.approx(0.995**-4)


def test_stubs_and_month_ends(spark):
    make = lambda issue, maturity, stub: _one(spark, x=finance.accrual_dates(_day(issue), _day(maturity), 2, stub)).x
    a, z = D(2023, 1, 15), D(2024, 8, 31)
    assert make(a, z, "short_first") == [a, D(2023, 2, 28), D(2023, 8, 31), D(2024, 2, 29), z]
    assert make(a, z, "long_first") == [a, D(2023, 8, 31), D(2024, 2, 29), z]
    assert make(a, z, "short_last") == [a, D(2023, 7, 15), D(2024, 1, 15), D(2024, 7, 15), z]
    assert make(a, z, "long_last") == [a, D(2023, 7, 15), D(2024, 1, 15), z]
    even = [D(2023, 1, 15), D(2023, 7, 15), D(2024, 1, 15)]
    assert all(make(even[0], even[2], s) == even for s in ("short_first", "long_first", "short_last", "long_last"))
    assert make(a, D(2023, 2, 1), "long_first") == [a, D(2023, 2, 1)]
    assert make(z, a, "short_first") is None


def test_days_move_within_the_month(spark):
    holidays = F.array(_day(D(2024, 3, 29)))
    r = _one(spark, **{c: finance.adjust_day(_day(D(2024, 3, 30)), c, holidays) for c in ("unadjusted", "following", "preceding", "modified_following")})
    assert r == (D(2024, 3, 30), D(2024, 4, 1), D(2024, 3, 28), D(2024, 3, 28))


def test_par_bond_on_a_coupon_date(spark):
    accrual = finance.accrual_dates(_day(D(2020, 6, 30)), _day(D(2030, 6, 30)), 2)
    flows = finance.bond_flows(accrual, _day(D(2022, 6, 30)), F.lit(100.0), F.lit(0.04), "30/360")
    accrued = finance.accrued_interest(accrual, _day(D(2022, 6, 30)), F.lit(100.0), F.lit(0.04), "30/360")
    df = spark.range(1).select(flows.alias("flows"), accrued.alias("accrued"))
    r = df.select("flows", "accrued", finance.bond_values(F.col("flows"), F.col("accrued"), F.lit(0.04), 2).alias("v")).first()
    assert len(r.flows) == 16 and r.accrued == 0 and r.v.clean == pytest.approx(100)
    assert r.v.dv01 == pytest.approx(r.v.dirty * r.v.macaulay / 1.02 * 1e-4)
    y = df.select(*[finance.yield_to_maturity(F.col("flows"), F.col("accrued"), F.lit(p), F.lit(0.04), 2).alias(f"p{i}") for i, p in enumerate((100.0, 180.0, -5.0))]).first()
    assert y.p0 == pytest.approx(0.04) and y.p1 < 0 and y.p2 is None
    assert sum(f.amount * (1 + y.p1 / 2) ** (-2 * f.years) for f in r.flows) == pytest.approx(180)


def test_yield_of_no_flows_is_null(spark):
    none = F.array().cast("array<struct<years:double,amount:double>>")
    df = spark.range(2).select(none.alias("flows"))
    got = df.select(finance.yield_to_maturity(F.col("flows"), F.lit(0.0), F.lit(100.0), F.lit(0.05), 2).alias("y"), finance.bond_values(F.col("flows"), F.lit(0.0), F.lit(0.05), 2).alias("v")).collect()
    assert all(r.y is None and r.v is None for r in got)


def test_curve_is_flat_outside_its_nodes(spark):
    nodes = [(1.0, 0.02), (3.0, 0.04)]
    r = _one(spark, low=finance.zero_rate(F.lit(0.2), nodes), mid=finance.zero_rate(F.lit(2.5), nodes), high=finance.zero_rate(F.lit(9.0), nodes), before=finance.zero_rate(F.lit(-1.0), nodes), fwd=finance.forward_rate(F.lit(1.0), F.lit(3.0), nodes), no=finance.forward_rate(F.lit(3.0), F.lit(1.0), nodes))
    assert r.low == 0.02 and r.mid == pytest.approx(0.035) and r.high == 0.04 and r.before is None and r.fwd == pytest.approx(0.05) and r.no is None


@pytest.mark.parametrize("call", [True, False])
def test_greeks_are_the_slopes_of_the_price(spark, call):
    n = NormalDist().cdf

    def price(s, k, t, r, q, v):
        d = (math.log(s / k) + (r - q + v * v / 2) * t) / (v * math.sqrt(t))
        c = s * math.exp(-q * t) * n(d) - k * math.exp(-r * t) * n(d - v * math.sqrt(t))
        return c if call else c - s * math.exp(-q * t) + k * math.exp(-r * t)

    at = dict(s=100.0, k=110.0, t=0.7, r=0.03, q=0.01, v=0.3)
    g = finance.option_greeks(spark.range(1), call, *[F.lit(x) for x in at.values()]).first()
    slope = lambda name, h=1e-4: (price(**at | {name: at[name] + h}) - price(**at | {name: at[name] - h})) / 2 / h
    assert g.price == pytest.approx(price(**at), abs=1e-11)
    assert [g.delta, g.vega, -g.theta, g.rho] == pytest.approx([slope("s"), slope("v"), slope("t"), slope("r")], abs=1e-5)
    assert g.gamma == pytest.approx((price(**at | {"s": 100.1}) - 2 * price(**at) + price(**at | {"s": 99.9})) / 0.01, abs=1e-6)


def test_options_at_the_edges(spark):
    rows = [(100.0, 90.0, 0.0, 0.2), (100.0, 100.0, 0.0, 0.2), (100.0, 110.0, 0.0, 0.2), (100.0, 90.0, 1.0, 0.0), (100.0, 120.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "s double, k double, t double, v double")
    c, rate, zero = F.col, F.lit(0.05), F.lit(0.0)
    calls = finance.option_greeks(df, True, c("s"), c("k"), c("t"), rate, zero, c("v")).collect()
    puts = finance.option_greeks(df, False, c("s"), c("k"), c("t"), rate, zero, c("v")).collect()
    assert [r.delta for r in calls] == [1, 0.5, 0, 1, 0] and [r.delta for r in puts] == [0, -0.5, -1, 0, -1]
    late = math.exp(-0.05)
    assert [r.price for r in calls] == pytest.approx([10, 0, 0, 100 - 90 * late, 0]) and [r.price for r in puts] == pytest.approx([0, 0, 10, 0, 120 * late - 100])
    assert all(r.gamma == r.vega == 0 for r in calls + puts) and all(r.theta == 0 and r.rho == 0 for r in (calls + puts)[:3])


def test_implied_volatility_respects_arbitrage(spark):
    df = spark.createDataFrame([(0.5,), (10.0,), (99.0,), (101.0,), (None,)], "p double")
    solve = finance.implied_volatility(True, F.col("p"), F.lit(100.0), F.lit(100.0), F.lit(1.0), F.lit(0.01), F.lit(0.0))
    v = [r.v for r in df.select(solve.alias("v")).collect()]
    assert v[0] is None and v[3] is None and v[4] is None and v[1] > 0.2 and v[2] > 2
    again = finance.option_greeks(spark.range(1), True, F.lit(100.0), F.lit(100.0), F.lit(1.0), F.lit(0.01), F.lit(0.0), F.lit(v[2])).first()
    assert again.price == pytest.approx(99, abs=1e-7)


def test_contract_sizes(spark):
    sized = lambda **kw: _one(spark, **contracts.contract_size(F.lit(10000.0), 0.01, F.lit(50.0), kw.pop("stop", F.lit(48.0)), F.lit(5.0), kw.pop("fx", F.lit(1.0)), **kw))
    assert sized() == (10.0, 100.0, False, False)
    assert sized(max_leverage=0.2).size == 8 and sized(max_leverage=0.2).capped_by_leverage
    assert sized(max_leverage=0.2, max_notional=1600.0) == (6.0, 60.0, True, True)
    assert sized(least=20.0).size == 0 and sized(stop=F.lit(50.0)).size == 0
    assert sized(fx=F.lit(None).cast("double")).size is None


def test_rates_turn_round_but_do_not_cross(spark):
    rates = spark.createDataFrame([("EUR", "USD", 1.25), ("USD", "JPY", 100.0), ("BAD", "USD", 0.0)], "base string, quote string, rate double")
    pairs = spark.createDataFrame([("EUR", "USD"), ("USD", "EUR"), ("EUR", "JPY"), ("X", "X"), ("BAD", "USD"), (None, "USD")], "f string, t string")
    got = {(r.f, r.t): r.fx for r in contracts.with_fx(pairs, rates, "f", "t").collect()}
    assert got == {("EUR", "USD"): 1.25, ("USD", "EUR"): 0.8, ("EUR", "JPY"): None, ("X", "X"): 1.0, ("BAD", "USD"): None, (None, "USD"): None}


def test_queries_register_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    root = Path(__file__).resolve().parents[2]
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("name", ["fixed_rate_bond", "yield_to_maturity", "coupon_schedule"])
def test_bonds_are_dealt_over_all_cores(spark, name):
    """The table's file has one row group, so one task would have all of them."""
    from tidemark import catalog

    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.01").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_rolled_day_is_searched_once_in_each_direction(spark):
    days = F.array(F.lit("2022-03-31").cast("date"))
    column = finance.adjust_day(F.col("d"), "modified_following", days)
    assert str(column).count("sequence") == 2
    rows = spark.sql("SELECT explode(array(DATE'2022-03-31', DATE'2022-04-02', DATE'2022-04-30', CAST(NULL AS DATE))) AS d").select("d", column.alias("m")).collect()
    assert [str(r.m) for r in rows] == ["2022-03-30", "2022-04-04", "2022-04-29", "None"]
