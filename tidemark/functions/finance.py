"""Finance as Spark columns: day counts, schedules, bonds, curves, options, position sizes.

Yields and implied volatilities are solved by Arrow functions over whole batches; all else stays in the JVM.
"""

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def days_30_360(start: Column, end: Column) -> Column:
    """30/360 days (bond basis, without a February rule)."""
    d1 = F.least(F.day(start), F.lit(30))
    d2 = F.when((F.day(end) == 31) & (d1 == 30), 30).otherwise(F.day(end))
    return 360 * (F.year(end) - F.year(start)) + 30 * (F.month(end) - F.month(start)) + d2 - d1


def bond_price(face: Column, coupon: Column, yield_: Column, years: Column, frequency: int = 2) -> Column:
    """Price on a coupon date: an annuity of coupons and the face value."""
    n, c, y = years * frequency, face * coupon / frequency, yield_ / frequency
    return F.when(y == 0, face + c * n).otherwise(c * (1 - F.pow(1 + y, -n)) / y + face * F.pow(1 + y, -n))


def bond_duration(face: Column, coupon: Column, yield_: Column, years: Column, frequency: int = 2) -> Column:
    """Macaulay duration in years on a coupon date, for a positive yield."""
    n, c, y = years * frequency, coupon / frequency, yield_ / frequency
    top = 1 + y + n * (c - y)
    return ((1 + y) / y - top / (c * (F.pow(1 + y, n) - 1) + y)) / frequency


#: Hart's rational approximation of the normal distribution for |x| below 10 / sqrt 2 (fixed values, highest power first).
_HART_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_HART_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution to about 1e-15: Hart's approximation, and a continued fraction in the tails."""
    a = F.abs(x)
    density = F.exp(-a * a / 2)
    poly = lambda terms: functools.reduce(lambda acc, c: acc * a + F.lit(c), terms[1:], F.lit(terms[0]))
    fraction = functools.reduce(lambda acc, k: a + F.lit(float(k)) / acc, (4, 3, 2, 1), a + F.lit(0.65))
    tail = F.when(a > 37, 0.0).when(a < 7.07106781186547, density * poly(_HART_TOP) / poly(_HART_BOTTOM)).otherwise(density / fraction / math.sqrt(2 * math.pi))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def volatility_scale(volatility: Column, target: float, most: float) -> Column:
    """Exposure that brings a volatility to the target, at most `most`; 1 where it is unknown or zero."""
    return F.when(volatility > 0, F.least(F.lit(target) / volatility, F.lit(most))).otherwise(1.0)


def period_return(start: Column, end: Column, cashflow: Column, weight: float) -> Column:
    """Return of a period adjusted for money that came in, weighted by its share of the period; null without capital."""
    capital = start + weight * cashflow
    return F.when(capital > 0, (end - start - cashflow) / capital)


def range_distance(entry: Column, current: Column, true_range: Column) -> Column:
    """Distance of two prices in true ranges; null without range."""
    return F.when(true_range > 0, F.abs(current - entry) / true_range)


def option_value(spot: Column, strike: Column, rate: float, carry: float, vol: Column, years: Column) -> tuple[Column, Column]:
    """Call and put by the generalised Black-Scholes formula."""
    d1 = (F.log(spot / strike) + (carry + vol * vol / 2) * years) / (vol * F.sqrt(years))
    d2 = d1 - vol * F.sqrt(years)
    grow, pay = F.exp((carry - rate) * years), F.exp(-rate * years)
    call = spot * grow * normal_cdf(d1) - strike * pay * normal_cdf(d2)
    return call, call - spot * grow + strike * pay


def position_size(equity: Column, risk_percent: float, stop_distance: Column, tick: float, tick_value: float, price: Column, max_leverage: float) -> Column:
    """Units whose stop costs the risk share of equity, capped by leverage; 0 without a stop distance."""
    ticks = stop_distance / tick
    units = equity * risk_percent / 100 / (ticks * tick_value)
    return F.when(stop_distance <= 0, 0.0).otherwise(F.least(units, equity * max_leverage / price))


#: Day counts that year_fraction knows.
DAY_COUNTS = ("act/360", "act/365", "30/360", "act/act")


def year_fraction(start: Column, end: Column, convention: str) -> Column:
    """Years between two dates, negative where end is before start. act/act splits at year ends (ISDA)."""
    if convention not in DAY_COUNTS:
        raise ValueError(f"unknown day count {convention!r}")
    lo, hi = F.least(start, end), F.greatest(start, end)
    if convention == "act/act":
        first = lambda year: F.make_date(year, F.lit(1), F.lit(1))
        length = lambda year: F.datediff(first(year + 1), first(year))
        y0, y1 = F.year(lo), F.year(hi)
        years = F.datediff(first(y0 + 1), lo) / length(y0) + (y1 - y0 - 1) + F.datediff(hi, first(y1)) / length(y1)
    else:
        years = days_30_360(lo, hi) / 360 if convention == "30/360" else F.datediff(hi, lo) / (360 if convention == "act/360" else 365)
    return F.when(start == end, 0.0).when(start < end, years).otherwise(-years)


def discount_factor(rate: Column, years: Column, frequency: int = 0) -> Column:
    """Discount factor with `frequency` compoundings a year, continuous with 0; 0 for negative times and rates at or below -frequency."""
    if not frequency:
        return F.when(years < 0, 0.0).otherwise(F.exp(-rate * years))
    base = 1 + rate / frequency
    return F.when((years < 0) | (base <= 0), 0.0).otherwise(F.pow(base, -frequency * years))


def zero_rate(years: Column, nodes: list[tuple[float, float]]) -> Column:
    """Continuously compounded rate of a curve of (years, rate) nodes: linear between them, flat outside."""
    if not nodes or any(a[0] >= b[0] for a, b in zip(nodes, nodes[1:], strict=False)):
        raise ValueError("a curve needs nodes of ascending times")
    rate = F.when(years <= nodes[0][0], F.lit(nodes[0][1]))
    for (t0, r0), (t1, r1) in zip(nodes, nodes[1:], strict=False):
        rate = rate.when(years < t1, r0 + (years - t0) / (t1 - t0) * (r1 - r0))
    return F.when(years >= 0, rate.otherwise(nodes[-1][1]))


def forward_rate(start: Column, end: Column, nodes: list[tuple[float, float]]) -> Column:
    """Continuously compounded rate from start to end on that curve; null unless start is before end."""
    return F.when(end > start, (zero_rate(end, nodes) * end - zero_rate(start, nodes) * start) / (end - start))


def is_business_day(day: Column, holidays: Column) -> Column:
    """Neither Saturday nor Sunday nor in the array `holidays`."""
    return (F.weekday(day) < 5) & ~F.array_contains(holidays, day)


def adjust_day(day: Column, convention: str, holidays: Column) -> Column:
    """A date moved to a business day: unadjusted, following, preceding or modified_following; searches two weeks."""

    def roll(sign: int) -> Column:
        days = F.transform(F.sequence(F.lit(0), F.lit(13)), lambda k: F.date_add(day, k * sign))
        return F.coalesce(F.get(F.filter(days, lambda d: is_business_day(d, holidays)), F.lit(0)), F.date_add(day, 14 * sign))

    if convention == "modified_following":
        ahead = F.array(roll(1))  # bound, so that it is searched once
        return F.get(F.transform(ahead, lambda d: F.when(F.trunc(d, "month") == F.trunc(day, "month"), d).otherwise(roll(-1))), F.lit(0))
    return {"unadjusted": lambda: day, "following": lambda: roll(1), "preceding": lambda: roll(-1)}[convention]()


def accrual_dates(issue: Column, maturity: Column, frequency: int, stub: str = "short_first") -> Column:
    """Period boundaries from issue to maturity as an array, stepping from maturity (.._first) or issue (.._last).

    Dates stay at month ends where the anchor is one. A period that does not fit is kept short or joined to its neighbour.
    """
    if frequency not in (1, 2, 3, 4, 6, 12) or stub not in ("short_first", "long_first", "short_last", "long_last"):
        raise ValueError("frequency must divide 12; stub is short_ or long_ with first or last")
    step, back = 12 // frequency, stub.endswith("first")
    anchor, sign = (maturity, -step) if back else (issue, step)
    count = F.ceil(F.months_between(maturity, issue) / step).cast("int") + 1

    def at(k: Column) -> Column:
        moved = F.add_months(anchor, k * sign)
        return F.when(anchor == F.last_day(anchor), F.last_day(moved)).otherwise(moved)

    steps = F.transform(F.sequence(F.lit(0), count), at)
    inner = F.array_sort(F.filter(steps, lambda d: (d > issue) & (d < maturity)))
    if stub.startswith("long"):
        odd = (F.size(inner) > 0) & ~F.array_contains(steps, issue if back else maturity)
        inner = F.when(odd, F.slice(inner, 2, F.greatest(F.size(inner) - 1, F.lit(0))) if back else F.slice(inner, 1, F.greatest(F.size(inner) - 1, F.lit(0)))).otherwise(inner)
    return F.when(issue < maturity, F.concat(F.array(issue), inner, F.array(maturity)))


def bond_flows(accrual: Column, settlement: Column, face: Column, coupon: Column, convention: str, adjust: str = "unadjusted", holidays: Column | None = None) -> Column:
    """Payments after settlement as an array of (years, amount): coupons by day count, the face with the last."""
    free = F.array().cast("array<date>") if holidays is None else holidays
    periods = F.transform(F.sequence(F.lit(1), F.size(accrual) - 1), lambda k: F.struct(F.get(accrual, k - 1).alias("start"), F.get(accrual, k).alias("end"), adjust_day(F.get(accrual, k), adjust, free).alias("paid"), (k == F.size(accrual) - 1).alias("last")))
    flow = lambda p: F.struct(year_fraction(settlement, p["paid"], convention).alias("years"), (face * coupon * year_fraction(p["start"], p["end"], convention) + F.when(p["last"], face).otherwise(0.0)).alias("amount"))
    return F.transform(F.filter(periods, lambda p: p["paid"] > settlement), flow)


def accrued_interest(accrual: Column, settlement: Column, face: Column, coupon: Column, convention: str) -> Column:
    """Interest since the period's start; 0 on boundaries and outside the schedule."""
    begun = F.array_max(F.filter(accrual, lambda d: d <= settlement))
    inside = (begun < F.element_at(accrual, -1)) & (begun < settlement)
    return F.when(inside, face * coupon * year_fraction(begun, settlement, convention)).otherwise(0.0)


def bond_values(flows: Column, accrued: Column, ytm: Column, frequency: int) -> Column:
    """dirty, clean, macaulay, modified and dv01 at a yield compounded at the coupon frequency; null without flows."""
    worth = lambda f: f["amount"] * discount_factor(ytm, f["years"], frequency)
    zero = F.struct(F.lit(0.0).alias("dirty"), F.lit(0.0).alias("weighted"))
    sums = F.aggregate(flows, zero, lambda acc, f: F.struct((acc["dirty"] + worth(f)).alias("dirty"), (acc["weighted"] + f["years"] * worth(f)).alias("weighted")))

    def figures(s: Column) -> Column:
        macaulay = F.when(s["dirty"] > 0, s["weighted"] / s["dirty"]).otherwise(0.0)
        modified = macaulay / (1 + ytm / frequency)
        return F.struct(s["dirty"].alias("dirty"), (s["dirty"] - accrued).alias("clean"), macaulay.alias("macaulay"), modified.alias("modified"), (s["dirty"] * modified * 0.0001).alias("dv01"))

    return F.when(F.size(flows) > 0, F.get(F.transform(F.array(sums), figures), F.lit(0)))


def yield_to_maturity(flows: Column, accrued: Column, clean: Column, coupon: Column, frequency: int) -> Column:
    """The yield at which the flows are worth clean price and accrued interest; null where no yield matches to 1e-8.

    Newton steps over all bonds of an Arrow batch; a step out of the domain above -frequency is replaced by half the way to it.
    """

    @F.pandas_udf("double")
    def solve(years: pd.Series, amounts: pd.Series, dirty: pd.Series, start: pd.Series) -> pd.Series:
        if not len(years):
            return pd.Series([], dtype="float64")
        counts = np.array([0 if t is None else len(t) for t in years])
        place = np.arange(counts.max(initial=0))[None, :] < counts[:, None]
        t, a = np.zeros(place.shape), np.zeros(place.shape)
        if place.any():
            t[place], a[place] = np.concatenate([v for v in years if v is not None]), np.concatenate([v for v in amounts if v is not None])
        want, y = dirty.to_numpy("float64"), np.maximum(start.to_numpy("float64"), 0.01)
        for _ in range(200):
            with np.errstate(all="ignore"):
                worth = a * (1 + y / frequency)[:, None] ** (-frequency * t)
                off = worth.sum(axis=1) - want
                step = off * (1 + y / frequency) / (t * worth).sum(axis=1)
            done = ~(np.abs(off) >= 1e-8)
            if done.all():
                break
            moved = np.where(y + step > -frequency, y + step, (y - frequency) / 2)
            y = np.where(done, y, moved)
        return pd.Series(np.where((counts > 0) & (np.abs(off) < 1e-8), y, np.nan)).astype(object).where(lambda s: s.notna(), None)

    part = lambda name: F.transform(flows, lambda f: f[name])
    return solve(part("years"), part("amount"), F.when(clean > 0, clean + accrued), coupon)


def option_greeks(frame: DataFrame, call: bool, spot: Column, strike: Column, years: Column, rate: Column, dividend: Column, vol: Column) -> DataFrame:
    """Adds price, intrinsic, time_value, delta, gamma, vega, theta, theta_daily and rho of European options.

    Without time or volatility left the terminal price is the forward: the probabilities are 1, 0, or one half at the money.
    """
    fwd, pay, root, none = spot * F.exp(-dividend * years), strike * F.exp(-rate * years), F.sqrt(years), (years <= 1e-12) | (vol <= 1e-12)
    near = F.when(years <= 1e-12, F.abs(spot - strike) < 1e-12).otherwise(F.abs(fwd - pay) <= 1e-12 * F.greatest(fwd, pay))
    sure = F.when(near, 0.5).when(fwd > pay, 1.0).otherwise(0.0)
    d1 = F.when(~none, (F.log(spot / strike) + (rate - dividend + vol * vol / 2) * years) / (vol * root))
    staged = frame.withColumns({"_fwd": fwd, "_pay": pay, "_sure": sure, "_d1": d1, "_t": years, "_vol": vol, "_s": spot, "_r": rate, "_q": dividend, "_intrinsic": F.greatest((spot - strike) * (1 if call else -1), F.lit(0.0))})
    c = F.col
    staged = staged.withColumns({"_n1": F.when(c("_d1").isNull(), c("_sure")).otherwise(normal_cdf(c("_d1"))), "_n2": F.when(c("_d1").isNull(), c("_sure")).otherwise(normal_cdf(c("_d1") - c("_vol") * F.sqrt("_t"))), "_dens": F.when(c("_d1").isNull(), 0.0).otherwise(normal_pdf(c("_d1")))})
    n1, n2 = (c("_n1"), c("_n2")) if call else (c("_n1") - 1, c("_n2") - 1)
    width = F.when(c("_d1").isNull(), 1.0).otherwise(c("_vol") * F.sqrt("_t"))
    share = c("_fwd") / c("_s")
    theta = F.when(c("_t") <= 1e-12, 0.0).otherwise(-F.when(c("_d1").isNull(), 0.0).otherwise(c("_fwd") * c("_dens") * c("_vol") / (2 * F.sqrt("_t"))) - c("_r") * c("_pay") * n2 + c("_q") * c("_fwd") * n1)
    out = staged.withColumns({"price": c("_fwd") * n1 - c("_pay") * n2, "intrinsic": c("_intrinsic"), "delta": share * n1, "gamma": share * c("_dens") / (c("_s") * width), "vega": c("_fwd") * F.sqrt("_t") * c("_dens"), "theta": theta, "rho": c("_pay") * c("_t") * n2})
    out = out.withColumns({"time_value": F.greatest(c("price") - c("intrinsic"), F.lit(0.0)), "theta_daily": c("theta") / 365})
    return out.drop("_fwd", "_pay", "_sure", "_d1", "_t", "_vol", "_s", "_r", "_q", "_intrinsic", "_n1", "_n2", "_dens")


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def black_76(frame: DataFrame, call: bool, forward: Column, strike: Column, years: Column, rate: Column, vol: Column) -> DataFrame:
    """option_greeks of an option on a forward that is held fixed, so rho comes from discounting alone."""
    held = frame.withColumn("_years", years)
    return option_greeks(held, call, forward, strike, years, rate, rate, vol).withColumn("rho", -F.col("_years") * F.col("price")).drop("_years")


def parity_gap(call: Column, put: Column, spot: Column, strike: Column, years: Column, rate: Column, dividend: Column) -> Column:
    """Call less put, less the forward's present value; 0 where put-call parity holds."""
    return call - put - (spot * F.exp(-dividend * years) - strike * F.exp(-rate * years))


def _cdf(x: np.ndarray) -> np.ndarray:
    """normal_cdf over an array."""
    a = np.abs(x)
    tail = np.exp(-a * a / 2) * np.polyval(_HART_TOP, a) / np.polyval(_HART_BOTTOM, a)
    return np.where(x > 0, 1 - tail, tail)


def implied_volatility(call: bool, price: Column, spot: Column, strike: Column, years: Column, rate: Column, dividend: Column) -> Column:
    """Volatility that gives the price, by Newton steps kept inside a bracket; null outside the bounds of arbitrage."""

    @F.pandas_udf("double")
    def solve(p: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series, q: pd.Series) -> pd.Series:
        p, s, k, t, r, q = (v.to_numpy("float64") for v in (p, s, k, t, r, q))
        with np.errstate(all="ignore"):
            fwd, pay, root = s * np.exp(-q * t), k * np.exp(-r * t), np.sqrt(t)
            want = p if call else p + fwd - pay  # the call of the same strike
            valid = (t > 0) & (want > np.maximum(fwd - pay, 0)) & (want < fwd)
            lo, hi, v = np.full(p.shape, 1e-10), np.full(p.shape, 64.0), np.full(p.shape, 0.3)
            for _ in range(200):
                d1 = np.log(fwd / pay) / (v * root) + v * root / 2
                off = fwd * _cdf(d1) - pay * _cdf(d1 - v * root) - want
                lo, hi = np.where(off < 0, v, lo), np.where(off >= 0, v, hi)
                step = v - off * math.sqrt(2 * math.pi) / (fwd * root * np.exp(-d1 * d1 / 2))
                done = ~valid | (np.abs(off) <= 1e-13 * fwd) | (hi - lo < 1e-12)
                if done.all():
                    break
                v = np.where(done, v, np.where((step > lo) & (step < hi), step, (lo + hi) / 2))
            solved = valid & ((np.abs(off) < 1e-8) | (hi - lo < 1e-10))
        return pd.Series(np.where(solved, v, np.nan)).astype(object).where(lambda x: x.notna(), None)

    return solve(price, spot, strike, years, rate, dividend)


def expiry_result(call: bool, bought: bool, strike: Column, premium: Column, size: Column, underlying: Column) -> Column:
    """Result at expiry of an option bought or sold at a premium."""
    worth = F.greatest((underlying - strike) * (1 if call else -1), F.lit(0.0))
    return (worth - premium if bought else premium - worth) * size


def expiry_profile(call: bool, bought: bool, strike: Column, premium: Column, size: Column) -> dict[str, Column]:
    """break_even, max_profit and max_loss at expiry; null stands for unlimited."""
    paid, most = premium * size, F.lit(None).cast("double") if call else (strike - premium) * size
    return {"break_even": strike + premium if call else strike - premium, "max_profit": most if bought else paid, "max_loss": paid if bought else most}
