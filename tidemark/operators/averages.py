"""Moving averages, bands and channels."""

from __future__ import annotations

import math

from .spec import CUM, Fold, Operator, P, operator, since, w


def op(stages, outputs=("value",), warmup=1):
    return Operator("", list(stages), list(outputs), {}, warmup)


def wma_of(x: str, n: int) -> str:
    """Linear weights 1..n by way of the regression slope, so that one window serves any n."""
    return f"avg({x}) {w(n)} + coalesce(regr_slope({x}, i) {w(n)}, 0) * {(n - 1) / 6!r}"


@operator()
def sma(period=20):
    return op([{"value": since(f"avg(close) {w(period)}", period)}], warmup=period)


@operator()
def wma(period=20):
    return op([{"value": since(wma_of("close", period), period)}], warmup=period)


@operator()
def vwma(period=20):
    return op([{"value": since(f"CASE WHEN sum(volume) {w(period)} = 0 THEN close ELSE sum(close * volume) {w(period)} / nullif(sum(volume) {w(period)}, 0) END", period)}], warmup=period)


@operator()
def hma(period=20):
    last = max(1, math.floor(math.sqrt(period) + 0.5))
    return op(
        [
            {"half": wma_of("close", max(1, period // 2)), "whole": wma_of("close", period)},
            {"raw": since("2 * half - whole", period)},
            {"value": since(wma_of("raw", last), period + last - 1)},
        ],
        warmup=period + last - 1,
    )


@operator()
def alma(period=9, offset=0.85, sigma=6.0):
    peak, width = offset * (period - 1), period / sigma
    weights = [math.exp(-((k - peak) ** 2) / (2 * width * width)) for k in range(period)]
    total = sum(weights)
    terms = [f"{x / total!r} * " + (f"lag(close, {period - 1 - k}) {P}" if k < period - 1 else "close") for k, x in enumerate(weights)]
    return op([{"value": since(" + ".join(terms), period)}], warmup=period)


@operator()
def lsma(period=25):
    n = period
    return op(
        [
            {"fit": f"regr_slope(close, i) {w(n)}", "mean": f"avg(close) {w(n)}", "spread": f"var_pop(close) {w(n)}", "fit2": f"corr(close, i) {w(n)}"},
            {
                "value": since(f"mean + fit * {(n - 1) / 2!r}", n),
                "slope": since("fit", n),
                "intercept": since(f"mean - fit * {(n - 1) / 2!r}", n),
                "r2": since("CASE WHEN spread = 0 THEN 1.0 ELSE fit2 * fit2 END", n),
            },
        ],
        ["value", "slope", "intercept", "r2"],
        n,
    )


@operator()
def envelope(period=20, percent=2.5):
    return op(
        [{"basis": since(f"avg(close) {w(period)}", period)}, {"value": "basis", "upper": f"basis * {1 + percent / 100!r}", "lower": f"basis * {1 - percent / 100!r}"}],
        ["value", "basis", "upper", "lower"],
        period,
    )


@operator("bb")
def bollinger(len=20, mult=2.0):
    n = len
    return op(
        [
            {"basis": since(f"avg(close) {w(n)}", n), "dev": since(f"stddev_pop(close) {w(n)}", n)},
            {"value": "basis", "upper": f"basis + {mult!r} * dev", "lower": f"basis - {mult!r} * dev"},
            {"bandwidth": "(upper - lower) / basis", "percent_b": "CASE WHEN upper = lower THEN 0.5 ELSE (close - lower) / nullif(upper - lower, 0) END"},
        ],
        ["value", "basis", "upper", "lower", "percent_b"],
        n,
    )


@operator()
def donchian(period=20):
    n = period
    return op(
        [{"upper": since(f"max(high) {w(n)}", n), "lower": since(f"min(low) {w(n)}", n)}, {"value": "(upper + lower) / 2", "width": "upper - lower"}],
        ["value", "upper", "lower", "width"],
        n,
    )


@operator()
def ichimoku(tenkan_p=9, kijun_p=26, senkou_b_p=52):
    mid = lambda n: f"(max(high) {w(n)} + min(low) {w(n)}) / 2"
    first = max(tenkan_p, kijun_p, senkou_b_p)
    return op(
        [{"tenkan": since(mid(tenkan_p), first), "kijun": since(mid(kijun_p), first), "senkou_b": since(mid(senkou_b_p), first)}, {"senkou_a": "(tenkan + kijun) / 2"}],
        ["tenkan", "kijun", "senkou_a", "senkou_b"],
        first,
    )


@operator()
def vwap(window=390, slope_lookback=20):
    n = window
    return op(
        [
            {"sv": f"sum(volume) {w(n)}", "spv": f"sum(tp * volume) {w(n)}", "sppv": f"sum(tp * tp * volume) {w(n)}"},
            {"value": "CASE WHEN sv > 0 THEN spv / sv END"},
            {"sigma": "CASE WHEN sv > 0 THEN sqrt(greatest(sppv / sv - value * value, 0)) END", "slope": f"(value - lag(value, {slope_lookback}) {P}) / {slope_lookback}"},
            {"upper_1sigma": "value + sigma", "lower_1sigma": "value - sigma", "upper_2sigma": "value + 2 * sigma", "lower_2sigma": "value - 2 * sigma"},
        ],
        ["value", "slope"],
    )


@operator("avwap")
def anchored_vwap():
    day = "PARTITION BY series, day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return op(
        [
            {"day": "date_trunc('day', ts)", "weight": "CASE WHEN volume > 0 THEN volume ELSE 1.0 END"},
            {"sv": f"sum(weight) OVER ({day})", "spv": f"sum(tp * weight) OVER ({day})"},
            {"value": "spv / sv"},
        ]
    )


@operator()
def twap():
    day = "PARTITION BY series, day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return op([{"day": "date_trunc('day', ts)", "price": "(open + high + low + close) / 4"}, {"value": f"avg(price) OVER ({day})"}])


@operator()
def ema(period=20):
    return op([{"e": Fold("ema", "close", (period,))}, {"value": since("e", period)}], warmup=period)


@operator()
def rma(period=14):
    return op([{"value": Fold("rma", "close", (period,))}], warmup=period)


@operator()
def dema(period=20):
    return op([{"a": Fold("ema", "close", (period,))}, {"e1": since("a", period)}, {"b": Fold("ema", "e1", (period,))}, {"value": since("2 * e1 - b", 2 * period - 1)}], warmup=2 * period - 1)


@operator()
def tema(period=14):
    return op([{"a": Fold("ema", "close", (period,))}, {"b": Fold("ema", "a", (period,))}, {"c": Fold("ema", "b", (period,))}, {"value": since("3 * a - 3 * b + c", period)}], warmup=period)


@operator()
def t3(period=5, v=0.7):
    c1, c2, c3, c4 = -(v**3), 3 * v * v + 3 * v**3, -6 * v * v - 3 * v - 3 * v**3, 1 + 3 * v + v**3 + 3 * v * v
    chain = [{f"e{k}": Fold("ema", "close" if k == 1 else f"e{k - 1}", (period,))} for k in range(1, 7)]
    return op([*chain, {"value": since(f"{c1!r} * e6 + {c2!r} * e5 + {c3!r} * e4 + {c4!r} * e3", period)}], warmup=period)


@operator()
def zlema(period=20):
    lag = (period - 1) // 2
    return op([{"x": f"close + (close - lag(close, {lag}) {P})"}, {"value": Fold("ema", "x", (period,))}], warmup=lag + 1)


@operator()
def kama(period=10, fast_period=2, slow_period=30):
    return op([{"value": Fold("kama", "close", (period, fast_period, slow_period))}], warmup=period + 1)


@operator()
def super_smoother(period=10):
    return op([{"s": Fold("super_smoother", "close", (period,))}, {"value": since("s", period)}], warmup=period)


@operator()
def mcginley(period=14):
    return op([{"value": Fold("mcginley", "close", (period,))}])


@operator()
def vidya(cmo_len=9, ema_len=12):
    return op([{"value": Fold("vidya", "close", (cmo_len, ema_len))}], warmup=cmo_len + 1)


@operator()
def keltner(ema_period=20, atr_period=10, multiplier=2.0):
    return op(
        [
            {"basis": Fold("ema", "close", (ema_period,)), "width": f"avg(tr) {w(atr_period)}"},
            {"value": since("basis", atr_period), "atr": since("width", atr_period), "upper": since(f"basis + {multiplier!r} * width", atr_period), "lower": since(f"basis - {multiplier!r} * width", atr_period)},
        ],
        ["value", "upper", "lower", "atr"],
        atr_period,
    )


@operator()
def supertrend(period=10, multiplier=3.0):
    source = "high,low,close,width"
    return op(
        [
            {"width": since(f"avg(tr) {w(period)}", period)},
            {"value": Fold("supertrend", source, (multiplier, "line")), "trend": Fold("supertrend", source, (multiplier, "trend")), "upper": Fold("supertrend", source, (multiplier, "upper")), "lower": Fold("supertrend", source, (multiplier, "lower"))},
        ],
        ["value", "trend", "upper", "lower"],
        period,
    )


@operator("psar")
def parabolic_sar(step=0.02, max_step=0.2):
    return op([{"value": Fold("parabolic_sar", "high,low", (step, max_step, "sar")), "trend": Fold("parabolic_sar", "high,low", (step, max_step, "trend"))}], ["value", "trend"])


@operator()
def rising(period=5):
    """Whether the close rose over each of the last bars (1) or fell (-1)."""
    return op([{"d": f"close - lag(close, 1) {P}"}, {"value": f"CASE WHEN i > {period} THEN CASE WHEN min(d) {w(period)} > 0 THEN 1.0 WHEN max(d) {w(period)} < 0 THEN -1.0 ELSE 0.0 END END"}])


@operator()
def midas(source="hlc3"):
    """Volume-weighted mean price since the first bar."""
    return op([{"value": f"CASE WHEN sum(volume) {CUM} > 0 THEN sum(tp * volume) {CUM} / sum(volume) {CUM} END"}])
