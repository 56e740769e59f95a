"""Volatility, trend strength, volume and return statistics."""

from __future__ import annotations

import math
from dataclasses import replace

from .averages import op
from .oscillators import ratio
from .spec import CUM, Fold, P, operator, since, w


@operator()
def true_range():
    return op([{"value": "tr"}])


@operator()
def atr(atr_len=14, sig_len=20):
    return op([{"raw": Fold("rma", "tr", (atr_len,))}, {"value": "100 * raw / close"}, {"signal": Fold("rma", "value", (sig_len,))}], ["value", "raw", "signal"], atr_len)


@operator()
def adx(di_len=14, adx_smooth=14):
    return op(
        [
            {"up": f"high - lag(high, 1) {P}", "down": f"lag(low, 1) {P} - low", "r": "CASE WHEN pc IS NOT NULL THEN tr END"},
            {"pdm": "CASE WHEN pc IS NULL THEN NULL WHEN up > down AND up > 0 THEN up ELSE 0.0 END", "mdm": "CASE WHEN pc IS NULL THEN NULL WHEN down > up AND down > 0 THEN down ELSE 0.0 END"},
            {"ap": Fold("rma", "pdm", (di_len,)), "am": Fold("rma", "mdm", (di_len,)), "ar": Fold("rma", "r", (di_len,))},
            {"di_plus": "CASE WHEN ar IS NOT NULL THEN " + ratio("100 * ap", "ar", "0.0") + " END", "di_minus": "CASE WHEN ar IS NOT NULL THEN " + ratio("100 * am", "ar", "0.0") + " END"},
            {"dx": "CASE WHEN ar IS NOT NULL THEN " + ratio("100 * abs(di_plus - di_minus)", "di_plus + di_minus", "0.0") + " END"},
            {"value": Fold("rma", "dx", (adx_smooth,))},
        ],
        ["value", "di_plus", "di_minus"],
        di_len + adx_smooth,
    )


@operator()
def dmi(period=14):
    n = period
    return op(
        [
            {"up": f"high - lag(high, 1) {P}", "down": f"lag(low, 1) {P} - low", "r": "CASE WHEN pc IS NOT NULL THEN tr END"},
            {"pdm": "CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END", "mdm": "CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END"},
            {"plus_di": since(ratio(f"100 * sum(pdm) {w(n)}", f"sum(r) {w(n)}", "0.0"), n + 1), "minus_di": since(ratio(f"100 * sum(mdm) {w(n)}", f"sum(r) {w(n)}", "0.0"), n + 1)},
            {"value": "plus_di - minus_di"},
        ],
        ["value", "plus_di", "minus_di"],
        n + 1,
    )


@operator()
def ulcer_index(len=14):
    n = len
    return op(
        [{"hh": f"max(close) {w(n)}"}, {"dd": since("100 * (close - hh) / hh", n)}, {"value": since(f"sqrt(avg(dd * dd) {w(n)})", 2 * n - 1)}],
        warmup=2 * n - 1,
    )


_YEAR = repr(math.sqrt(252) * 100)


@operator()
def historical_volatility(period=20):
    return op([{"r": "ln(close / pc)"}, {"value": since(f"stddev_samp(r) {w(period)} * {_YEAR}", period + 1)}], warmup=period + 1)


@operator()
def garman_klass(period=20):
    c = repr(2 * math.log(2) - 1)
    return op([{"x": f"greatest(0.5 * pow(ln(high / low), 2) - {c} * pow(ln(close / open), 2), 0.0)"}, {"value": since(f"sqrt(avg(x) {w(period)}) * {_YEAR}", period)}], warmup=period)


@operator()
def parkinson(period=20, periods_per_year=252):
    return op([{"x": "pow(ln(high / low), 2)"}, {"value": since(f"100 * sqrt(avg(x) {w(period)} / {4 * math.log(2)!r} * {periods_per_year})", period)}], warmup=period)


@operator()
def rogers_satchell(period=20, periods_per_year=252):
    return op([{"x": "ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open)"}, {"value": since(f"100 * sqrt(greatest(avg(x) {w(period)}, 0.0) * {periods_per_year})", period)}], warmup=period)


@operator()
def yang_zhang(period=20, periods_per_year=252):
    n = period
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    return op(
        [
            {"o": "ln(open / pc)", "c": "ln(close / open)", "rs": "ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open)"},
            {"v": f"var_samp(o) {w(n)} + {k!r} * var_samp(c) {w(n)} + {1 - k!r} * avg(rs) {w(n)}"},
            {"value": since(f"100 * sqrt(greatest(v, 0.0) * {periods_per_year})", n + 1)},
        ],
        warmup=n + 1,
    )


@operator()
def mass_index(period=25):
    return op(
        [
            {"r": "high - low"},
            {"a": Fold("ema", "r", (9,))},
            {"b": Fold("ema", "a", (9,))},
            {"x": ratio("a", "b", "1.0")},
            {"value": since(f"sum(x) {w(period)}", period)},
        ],
        warmup=period,
    )


@operator("wvf")
def vix_fix(pd=22, bband_len=20, mult=2.0):
    """How far lows lie below the highest close, and highs above the lowest, each with a band; before `pd` closes the bar's own."""
    first = 2 * bband_len - 1
    band = lambda x: since(f"avg({x}) {w(bband_len)} + {mult!r} * stddev_pop({x}) {w(bband_len)}", first)
    return op(
        [
            {"hh": f"CASE WHEN i >= {pd} THEN max(close) {w(pd)} ELSE close END", "ll": f"CASE WHEN i >= {pd} THEN min(close) {w(pd)} ELSE close END"},
            {"x": "100 * (hh - low) / hh", "y": "100 * (high - ll) / high"},
            {"value": since("x", first), "band": band("x"), "inverse": since("y", first), "inverse_band": band("y")},
        ],
        ["value", "band", "inverse", "inverse_band"],
        first,
    )


@operator("leg_efficiency", "er")
def efficiency(len=14):
    n = len
    return op([{"d": "abs(close - pc)"}, {"value": since(ratio(f"abs(close - lag(close, {n}) {P})", f"sum(d) {w(n)}", "0.0"), n + 1)}], warmup=n + 1)


@operator()
def r_squared(period=20):
    n = period
    return op([{"s": f"var_pop(close) {w(n)}", "c": f"corr(close, i) {w(n)}"}, {"value": since("CASE WHEN s < 1e-14 THEN 1.0 ELSE c * c END", n)}], warmup=n)


@operator()
def volatility_regime(period=20, bb_mult=2.0, kc_mult=1.5):
    n = period
    return op(
        [
            {"s": f"stddev_pop(close) {w(n)}", "r": f"avg(tr) {w(n)}"},
            {"bb_width": since(f"2 * {bb_mult!r} * s", n), "kc_width": since(f"2 * {kc_mult!r} * r", n)},
            {"value": since("CASE WHEN bb_width < kc_width THEN -1.0 WHEN bb_width > 1.3 * kc_width THEN 1.0 ELSE 0.0 END", n)},
        ],
        ["value", "bb_width", "kc_width"],
        n,
    )


@operator()
def autocorrelation(period=50, lag=1):
    n, k = period, lag
    return op(
        [
            {"r": "ln(close / pc)"},
            {"m": f"avg(r) {w(n)}", "v": f"var_pop(r) {w(n)}", "past": f"lag(r, {k}) {P}"},
            {"sxy": f"sum(r * past) {w(n - k)}", "sx": f"sum(r) {w(n - k)}", "sy": f"sum(past) {w(n - k)}"},
            {"value": since(f"CASE WHEN v < 1e-18 THEN 0.0 ELSE (sxy - m * (sx + sy) + {n - k} * m * m) / nullif({n} * v, 0) END", n + 1)},
        ],
        warmup=n + 1,
    )


@operator()
def ar1_half_life(period=100):
    n = period
    return op(
        [{"f": f"regr_slope(close, pc) {w(n - 1)}"}, {"phi": since("CASE WHEN f > 0 AND f < 1 THEN f END", n)}, {"value": f"{-math.log(2)!r} / ln(phi)"}],
        ["value", "phi"],
        n,
    )


@operator()
def pvt():
    return op([{"x": "CASE WHEN pc > 0 THEN volume * (close / pc - 1) END"}, {"value": f"sum(x) {CUM}"}], warmup=2)


@operator()
def obv():
    return op([{"x": "CASE WHEN close > pc THEN volume WHEN close < pc THEN -volume ELSE 0.0 END"}, {"value": f"sum(x) {CUM}"}])


def _location(flat: str = "0.0") -> str:
    return f"CASE WHEN high = low THEN {flat} ELSE ((close - low) - (high - close)) / nullif(high - low, 0) END"


@operator()
def cmf(period=20):
    return op([{"x": f"volume * ({_location()})"}, {"value": since("greatest(-1.0, least(1.0, " + ratio(f"sum(x) {w(period)}", f"sum(volume) {w(period)}", "0.0") + "))", period)}], warmup=period)


@operator()
def acc_dist():
    return op([{"x": f"volume * ({_location()})"}, {"value": f"sum(x) {CUM}"}])


@operator("cho")
def chaikin_oscillator(fast_len=3, slow_len=10):
    return op([{"x": f"volume * ({_location()})"}, {"ad": f"sum(x) {CUM}"}, {"a": Fold("ema", "ad", (fast_len,)), "b": Fold("ema", "ad", (slow_len,))}, {"value": since("a - b", slow_len)}], warmup=slow_len)


@operator()
def cvd():
    return op(
        [
            {"share": "CASE WHEN high = low THEN 0.5 ELSE (close - low) / nullif(high - low, 0) END"},
            {"delta": "(2 * share - 1) * volume", "buy_volume": "share * volume", "sell_volume": "(1 - share) * volume"},
            {"value": f"sum(delta) {CUM}"},
        ],
        ["value", "delta", "buy_volume", "sell_volume"],
    )


@operator()
def efi(ema_len=13):
    return op([{"raw": "(close - pc) * volume"}, {"e": Fold("ema", "raw", (ema_len,))}, {"value": since("e", ema_len + 1)}], ["value", "raw"], ema_len + 1)


@operator()
def volume(ma_period=20):
    return op([{"value": "volume", "avg_volume": f"avg(volume) {w(ma_period)}"}, {"volume_ratio": ratio("value", "avg_volume", "0.0")}], ["value", "avg_volume", "volume_ratio"])


@operator()
def rvol(period=20):
    return op([{"m": f"avg(volume) {w(period)}"}, {"value": since(ratio("volume", "m", "0.0"), period)}], warmup=period)


@operator()
def market_facilitation():
    return op([{"value": "CASE WHEN volume > 0 THEN (high - low) / volume END"}])


@operator()
def eom(period=14, volume_divisor=10000.0):
    return op(
        [
            {"d": f"hl2 - lag(hl2, 1) {P}"},
            {"x": f"CASE WHEN d IS NULL THEN NULL WHEN volume > 0 AND high > low THEN d / nullif(volume / {volume_divisor!r} / nullif(high - low, 0), 0) ELSE 0.0 END"},
            {"value": since(f"avg(x) {w(period)}", period + 1)},
        ],
        warmup=period + 1,
    )


def _index(sign: str) -> list[dict]:
    return [
        {"pv": f"lag(volume, 1) {P}"},
        {"x": f"CASE WHEN volume {sign} pv AND pc > 0 THEN ln(close / pc) ELSE 0.0 END"},
        {"value": f"1000 * exp(sum(x) {CUM})"},
    ]


@operator()
def nvi():
    return replace(op(_index("<")), comparable=False)


@operator()
def pvi():
    return replace(op(_index(">")), comparable=False)


@operator("vpci")
def volume_price_confirmation(short=5, long=20, smoothing=20):
    mean = lambda n: ratio(f"sum(close * volume) {w(n)}", f"sum(volume) {w(n)}", "close")
    return op(
        [
            {"vs": mean(short), "vl": mean(long), "ss": f"avg(close) {w(short)}", "sl": f"avg(close) {w(long)}", "qs": f"avg(volume) {w(short)}", "ql": f"avg(volume) {w(long)}"},
            {"x": since("(vl - sl) * (vs / ss) * (" + ratio("qs", "ql", "0.0") + ")", long)},
            {"value": since("x", long + smoothing - 1), "signal": since(f"avg(x) {w(smoothing)}", long + smoothing - 1)},
        ],
        ["value", "signal"],
        long + smoothing - 1,
    )


@operator()
def variance_ratio(period=100, lag=4):
    n, q = period, lag
    return op(
        [
            {"r": "ln(close / pc)", "rq": f"ln(close / lag(close, {q}) {P})"},
            {"m": f"avg(r) {w(n)}", "v1": f"var_samp(r) {w(n)}", "s2": f"sum(rq * rq) {w(n - q + 1)}", "s1": f"sum(rq) {w(n - q + 1)}"},
            {"vq": f"(s2 - 2 * {q} * m * s1 + {n - q + 1} * {q * q} * m * m) / {q * (n - q + 1) * (1 - q / n)!r}"},
            {"value": since("CASE WHEN v1 < 1e-18 THEN NULL ELSE vq / nullif(v1, 0) END", n + 1)},
        ],
        warmup=n + 1,
    )
