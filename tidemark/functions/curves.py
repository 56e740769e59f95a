"""Zero curves and volatility surfaces as rows: thousands of them, joined to what they price.

A curve is a row with `nodes`, an array of (t, r) with ascending times; a surface is a row with its two axes and the grid of
volatilities. Look-ups are expressions over these arrays. Only the solution for the nodes runs in a grouped call, one curve
to a call, whose size is the number of its instruments.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .finance import year_fraction

#: Bounds between which a swap's node is sought, and halvings of the interval.
LOWEST, HIGHEST, HALVINGS = -0.5, 1.0, 100


def curves(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row for each curve of (by..., t, r), with `nodes` in ascending order; curves with repeated or null times are left out."""
    node = F.struct(F.col("t").cast("double").alias("t"), F.col("r").cast("double").alias("r"))
    found = rows.groupBy(*by).agg(F.sort_array(F.collect_list(node)).alias("nodes"), F.count_distinct("t").alias("times"), F.count(F.lit(1)).alias("rows"))
    return found.filter("times = rows").select(*by, "nodes")


def rate_at(nodes: Column, years: Column) -> Column:
    """Continuously compounded rate: straight lines between nodes, flat outside; null for negative times and empty curves."""
    low = F.try_element_at(F.filter(nodes, lambda n: n["t"] <= years), F.lit(-1))
    high = F.try_element_at(F.filter(nodes, lambda n: n["t"] > years), F.lit(1))


    def line(s: Column) -> Column:
        a, b = s["a"], s["b"]
        return F.when(a.isNull(), b["r"]).when(b.isNull(), a["r"]).otherwise(a["r"] + (years - a["t"]) / (b["t"] - a["t"]) * (b["r"] - a["r"]))

    ends = F.array(F.struct(low.alias("a"), high.alias("b")))  # an array of one, so both nodes are looked up once
    return F.when(years >= 0, F.get(F.transform(ends, line), F.lit(0)))


def discount_at(nodes: Column, years: Column) -> Column:
    return F.exp(-rate_at(nodes, years) * years)


def swap_periods(reference: Column, maturity: Column, frequency: Column, convention: str) -> Column:
    """Array of (t, accrual) of a swap's payments after `reference`: boundaries step back from maturity, staying at month ends
    where it is one; the first period begins at the last boundary not after `reference` and counts whole."""
    step = (F.lit(12) / frequency).cast("int")
    count = (F.floor(F.months_between(maturity, reference) / step) + 2).cast("int")

    def boundary(k: Column) -> Column:
        moved = F.add_months(maturity, -k * step)
        return F.when(maturity == F.last_day(maturity), F.last_day(moved)).otherwise(moved)

    paid = F.filter(F.sequence(F.lit(0), count), lambda k: boundary(k) > reference)
    each = lambda k: F.struct(year_fraction(reference, boundary(k), convention).alias("t"), year_fraction(boundary(k + 1), boundary(k), convention).alias("accrual"))
    return F.when(reference < maturity, F.reverse(F.transform(paid, each)))


def par_rate(nodes: Column, periods: Column) -> Column:
    """The fixed rate at which a swap of these periods is worth nothing; null without a positive annuity."""
    annuity = F.aggregate(periods, F.lit(0.0), lambda s, p: s + p["accrual"] * discount_at(nodes, p["t"]))
    last = F.try_element_at(periods, F.lit(-1))
    return F.when(annuity > 0, (1 - discount_at(nodes, last["t"])) / annuity)


def _solve(times: np.ndarray, kinds: list[str], rates: np.ndarray, periods: list) -> list[float] | None:
    """Node rates in order of time, each with the earlier ones held; None if an instrument has no solution."""
    t: list[float] = []
    r: list[float] = []
    for at, kind, rate, pays in zip(times, kinds, rates, periods, strict=True):
        if not np.isfinite(rate):
            return None
        if kind == "zero":
            t, r = [*t, at], [*r, float(rate)]
            continue
        when, accrual = (np.array([p[c] for p in pays], float) for c in ("t", "accrual"))

        def gap(candidate: float, when=when, accrual=accrual, at=at, rate=rate) -> float:
            discount = np.exp(-np.interp(when, [*t, at], [*r, candidate]) * when)
            return float(rate * (accrual @ discount) - (1 - discount[-1]))

        low, high = LOWEST, HIGHEST
        first = np.sign(gap(low))
        if first == np.sign(gap(high)):
            return None
        for _ in range(HALVINGS):
            middle = 0.5 * (low + high)
            side = np.sign(gap(middle))
            low, high = (middle, middle) if side == 0 else (middle, high) if side == first else (low, middle)
        t, r = [*t, at], [*r, 0.5 * (low + high)]
    return r


def bootstrap(instruments: DataFrame, convention: str = "act/365") -> DataFrame:
    """(curve, reference, nodes) from quotes (curve, reference, maturity, kind, rate, frequency), kind `zero` or `swap`.

    Quotes are taken by maturity; a swap's node makes it worth nothing given the earlier nodes. Curves with equal or past
    maturities, rates that are not finite or a swap that no rate from -50 % to 100 % prices are left out.
    """
    t = year_fraction(F.col("reference"), F.col("maturity"), convention)
    rows = instruments.select("curve", "reference", "maturity", "kind", F.col("rate").cast("double").alias("rate"), t.alias("t"), F.when(F.col("kind") == "swap", swap_periods(F.col("reference"), F.col("maturity"), F.col("frequency"), convention)).alias("periods"))
    kind = dict(instruments.dtypes)["curve"]

    def solve(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("maturity")
        late = (frame["maturity"] > frame["reference"]).all() and frame["maturity"].is_unique
        found = _solve(frame["t"].to_numpy(float), list(frame["kind"]), frame["rate"].to_numpy(float), list(frame["periods"])) if late else None
        return frame.iloc[:0][["curve", "reference", "t"]].assign(r=[]) if found is None else frame[["curve", "reference", "t"]].assign(r=found)

    return curves(rows.groupBy("curve", "reference").applyInPandas(solve, f"curve {kind}, reference date, t double, r double"), ["curve", "reference"])


def surfaces(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row for each surface of (by..., t, strike, vol): maturities, strikes and grid, by maturity then strike.

    Left out are surfaces whose grid has holes, repeated points, negative times, strikes not above 0 or bad volatilities.
    """
    point = F.struct(*[F.col(c).cast("double").alias(c) for c in ("t", "strike", "vol")])
    fine = (F.col("t") >= 0) & (F.col("strike") > 0) & (F.col("vol") >= 0) & (F.col("vol") < float("inf"))
    found = rows.groupBy(*by).agg(F.sort_array(F.collect_list(point)).alias("p"), F.min(F.coalesce(fine, F.lit(False))).alias("fine"), F.sort_array(F.collect_set(F.col("t").cast("double"))).alias("maturities"), F.sort_array(F.collect_set(F.col("strike").cast("double"))).alias("strikes"), F.count_distinct("t", "strike").alias("points"))
    whole = found.filter(F.col("fine") & (F.col("points") == F.size("p")) & (F.size("p") == F.size("maturities") * F.size("strikes")))
    return whole.select(*by, "maturities", "strikes", F.transform("p", lambda x: x["vol"]).alias("grid"))


def _bracket(axis: Column, value: Column) -> tuple[Column, Column, Column]:
    """Places (from 0) of the axis values around `value`, held at the ends, and the weight of the upper one."""
    below = F.size(F.filter(axis, lambda x: x <= value))
    low, high = F.greatest(below - 1, F.lit(0)), F.least(below, F.size(axis) - 1)
    a, b = F.get(axis, low), F.get(axis, high)
    return low, high, F.when(b > a, (value - a) / (b - a)).otherwise(0.0)


def volatility_at(maturities: Column, strikes: Column, grid: Column, years: Column, strike: Column, strike_slack: float = 0.1, years_slack: float = 0.25) -> Column:
    """Bilinear volatility, flat at the edges; null for negative times, strikes not above 0, and points farther out than
    `years_slack` past the last maturity or `strike_slack` of the strikes' range beyond either end."""
    r0, r1, rw = _bracket(maturities, years)
    c0, c1, cw = _bracket(strikes, strike)
    width = F.size(strikes)

    def row(r: Column) -> Column:
        a, b = F.get(grid, r * width + c0), F.get(grid, r * width + c1)
        return a + cw * (b - a)

    slack = strike_slack * (F.array_max(strikes) - F.array_min(strikes))
    inside = (years >= 0) & (strike > 0) & (years <= F.array_max(maturities) + years_slack) & (strike >= F.array_min(strikes) - slack) & (strike <= F.array_max(strikes) + slack)
    return F.when(inside, row(r0) + rw * (row(r1) - row(r0)))
