"""Oscillators."""

from __future__ import annotations

import math

from .averages import op, wma_of
from .spec import Fold, P, operator, since, w


def ratio(top: str, bottom: str, flat: str) -> str:
    return f"CASE WHEN ({bottom}) = 0 THEN {flat} ELSE ({top}) / nullif(({bottom}), 0) END"


def strength(up: str, down: str, both: str = "50.0") -> str:
    """100 - 100 / (1 + up / down) with its flat cases."""
    return f"CASE WHEN ({up}) = 0 AND ({down}) = 0 THEN {both} WHEN ({down}) = 0 THEN 100.0 WHEN ({up}) = 0 THEN 0.0 ELSE 100.0 - 100.0 / (1 + ({up}) / ({down})) END"


@operator()
def macd(fast_len=12, slow_len=26, signal_len=9):
    return op(
        [
            {"f": Fold("ema", "close", (fast_len,)), "s": Fold("ema", "close", (slow_len,))},
            {"value": since("f - s", slow_len)},
            {"signal": Fold("ema", "value", (signal_len,))},
            {"hist": "value - signal"},
        ],
        ["value", "signal", "hist"],
        slow_len,
    )


@operator()
def ppo(fast_period=12, slow_period=26, signal_period=9):
    return op(
        [
            {"f": Fold("ema", "close", (fast_period,)), "s": Fold("ema", "close", (slow_period,))},
            {"value": since("100 * (f - s) / s", slow_period)},
            {"signal": Fold("ema", "value", (signal_period,))},
            {"hist": "value - signal"},
        ],
        ["value", "signal", "hist"],
        slow_period,
    )


@operator()
def trix(len=15, signal_len=9):
    n = len
    return op(
        [
            {"a": Fold("ema", "close", (n,))},
            {"b": Fold("ema", "a", (n,))},
            {"c": Fold("ema", "b", (n,))},
            {"value": since(f"100 * (c / lag(c, 1) {P} - 1)", n + 1)},
            {"signal": Fold("ema", "value", (signal_len,))},
            {"hist": "value - signal"},
        ],
        ["value", "signal", "hist"],
        n + 1,
    )


@operator()
def tsi(long_len=25, short_len=13, sig_len=7):
    return op(
        [
            {"m": "close - pc"},
            {"am": "abs(m)"},
            {"a": Fold("ema", "m", (long_len,)), "b": Fold("ema", "am", (long_len,))},
            {"a2": Fold("ema", "a", (short_len,)), "b2": Fold("ema", "b", (short_len,))},
            {"value": "CASE WHEN a2 IS NOT NULL THEN " + ratio("100 * a2", "b2", "0.0") + " END"},
            {"signal": Fold("ema", "value", (sig_len,))},
        ],
        ["value", "signal"],
        2,
    )


@operator()
def smi(len=10, smooth_1=3, smooth_2=3, signal_len=3):
    n = len
    return op(
        [
            {"hh": since(f"max(high) {w(n)}", n), "ll": since(f"min(low) {w(n)}", n)},
            {"d": "close - (hh + ll) / 2", "r": "hh - ll"},
            {"d1": Fold("ema", "d", (smooth_1,)), "r1": Fold("ema", "r", (smooth_1,))},
            {"d2": Fold("ema", "d1", (smooth_2,)), "r2": Fold("ema", "r1", (smooth_2,))},
            {"raw": ratio("200 * d2", "r2", "0.0")},
            {"value": since("raw", n + smooth_1 + smooth_2 - 2)},
            {"signal": Fold("ema", "value", (signal_len,))},
        ],
        ["value", "signal"],
        n + smooth_1 + smooth_2 - 2,
    )


@operator()
def stochastic(k_period=14, d_period=3):
    first = k_period + d_period - 1
    return op(
        [
            {"hh": f"max(high) {w(k_period)}", "ll": f"min(low) {w(k_period)}"},
            {"k": since("least(100.0, greatest(0.0, " + ratio("100 * (close - ll)", "hh - ll", "50.0") + "))", k_period)},
            {"percent_k": since("k", first), "percent_d": since(f"avg(k) {w(d_period)}", first)},
            {"value": "percent_k"},
        ],
        ["value", "percent_k", "percent_d"],
        first,
    )


@operator()
def roc(period=12):
    return op([{"past": f"lag(close, {period}) {P}"}, {"value": "CASE WHEN past IS NULL THEN NULL WHEN past <= 0 THEN 0.0 ELSE 100 * (close / past - 1) END", "abs_momentum": "close - past"}], ["value", "abs_momentum"], period + 1)


@operator()
def ultimate_oscillator(period1=7, period2=14, period3=28):
    part = lambda n: ratio(f"sum(bp) {w(n)}", f"sum(r) {w(n)}", "0.0")
    first = max(period1, period2, period3) + 1
    return op(
        [
            {"bp": "CASE WHEN pc IS NOT NULL THEN close - least(low, pc) END", "r": "CASE WHEN pc IS NOT NULL THEN greatest(high, pc) - least(low, pc) END"},
            {"value": since(f"100 * (4 * ({part(period1)}) + 2 * ({part(period2)}) + ({part(period3)})) / 7", first)},
        ],
        warmup=first,
    )


@operator()
def awesome_oscillator(fast_period=5, slow_period=34):
    return op([{"value": since(f"avg(hl2) {w(fast_period)} - avg(hl2) {w(slow_period)}", slow_period)}], warmup=slow_period)


@operator()
def cmo(period=14):
    return op(
        [
            {"u": "CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0.0) END", "d": "CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0.0) END"},
            {"su": f"sum(u) {w(period)}", "sd": f"sum(d) {w(period)}"},
            {"value": since(ratio("100 * (su - sd)", "su + sd", "0.0"), period + 1)},
        ],
        warmup=period + 1,
    )


@operator()
def elder_ray(period=13):
    return op([{"e": Fold("ema", "close", (period,))}, {"ema": since("e", period), "bull_power": since("high - e", period), "bear_power": since("low - e", period)}], ["bull_power", "bear_power", "ema"], period)


@operator()
def coppock():
    return op([{"r14": f"100 * (close / lag(close, 14) {P} - 1)", "r11": f"100 * (close / lag(close, 11) {P} - 1)"}, {"x": "r14 + r11"}, {"value": since(wma_of("x", 10), 24)}], warmup=24)


@operator()
def dpo(period=21):
    back = period // 2 + 1
    return op([{"m": since(f"avg(close) {w(period)}", period)}, {"value": f"close - lag(m, {back}) {P}"}], warmup=period + back)


@operator()
def kst():
    terms = [(10, 10, 1), (15, 10, 2), (20, 10, 3), (30, 15, 4)]
    return op(
        [
            {f"r{a}": f"100 * (close / lag(close, {a}) {P} - 1)" for a, _, _ in terms},
            {f"m{a}": since(f"avg(r{a}) {w(b)}", a + b) for a, b, _ in terms},
            {"line": since(" + ".join(f"{k} * m{a}" for a, _, k in terms), 45)},
            {"kst": since("line", 53), "signal": since(f"avg(line) {w(9)}", 53)},
            {"value": "kst", "hist": "kst - signal"},
        ],
        ["value", "signal", "hist"],
        53,
    )


@operator()
def rvi(period=10):
    smooth = lambda x: f"({x} + 2 * lag({x}, 1) {P} + 2 * lag({x}, 2) {P} + lag({x}, 3) {P}) / 6"
    return op(
        [
            {"a": "close - open", "b": "high - low"},
            {"sa": smooth("a"), "sb": smooth("b")},
            {"line": since(ratio(f"sum(sa) {w(period)}", f"sum(sb) {w(period)}", "0.0"), period + 3)},
            {"sig": since(smooth("line"), period + 6)},
            {"value": since("line", period + 6), "signal": "sig"},
        ],
        ["value", "signal"],
        period + 6,
    )


@operator()
def bop(period=14):
    return op([{"x": "(close - open) / greatest(high - low, 1e-8)"}, {"value": since(f"greatest(-1.0, least(1.0, avg(x) {w(period)}))", period)}], warmup=period)


@operator()
def bbtrend(short_len=20, long_len=50, mult=2.0):
    band = lambda n, s: f"avg(close) {w(n)} {s} {mult!r} * stddev_pop(close) {w(n)}"
    return op(
        [
            {"us": band(short_len, "+"), "ul": band(long_len, "+"), "ls": band(short_len, "-"), "ll": band(long_len, "-"), "basis": f"avg(close) {w(short_len)}"},
            {"upper_gap": since("abs(us - ul)", long_len), "lower_gap": since("abs(ls - ll)", long_len)},
            {"value": "100 * (lower_gap - upper_gap) / basis"},
        ],
        ["value", "upper_gap", "lower_gap"],
        long_len,
    )


@operator()
def zscore(period=20):
    return op([{"m": f"avg(close) {w(period)}", "s": f"stddev_pop(close) {w(period)}"}, {"value": since("CASE WHEN s < 1e-8 THEN 0.0 ELSE (close - m) / nullif(s, 0) END", period)}], warmup=period)


def _gains(n: int) -> list[dict]:
    return [
        {"u": "CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0.0) END", "d": "CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0.0) END"},
        {"ru": Fold("rma", "u", (n,)), "rd": Fold("rma", "d", (n,))},
        {"raw": f"CASE WHEN ru IS NOT NULL THEN {strength('ru', 'rd')} END"},
    ]


@operator()
def rsi(rsi_len=14, avg_len=3, sig_len=3):
    return op([*_gains(rsi_len), {"value": Fold("ema", "raw", (avg_len,)), "ctx": Fold("ema", "raw", (100,))}, {"signal": Fold("ema", "value", (sig_len,))}], ["value", "raw", "signal"], rsi_len + 1)


@operator("srsi")
def stoch_rsi(rsi_len=14, stoch_len=14, k_len=3, d_len=3):
    a = rsi_len + stoch_len
    return op(
        [
            *_gains(rsi_len),
            {"hh": f"max(raw) {w(stoch_len)}", "ll": f"min(raw) {w(stoch_len)}"},
            {"k0": since(ratio("100 * (raw - ll)", "hh - ll", "50.0"), a)},
            {"k": since(f"avg(k0) {w(k_len)}", a + k_len - 1)},
            {"value": since("k", a + k_len + d_len - 2), "signal": since(f"avg(k) {w(d_len)}", a + k_len + d_len - 2)},
        ],
        ["value", "signal"],
        a + k_len + d_len - 2,
    )


@operator()
def relative_momentum_index(length=20, momentum=5):
    return op(
        [
            {"ch": f"close - lag(close, {momentum}) {P}"},
            {"u": "CASE WHEN ch IS NOT NULL THEN greatest(ch, 0.0) END", "d": "CASE WHEN ch IS NOT NULL THEN greatest(-ch, 0.0) END"},
            {"ru": Fold("rma", "u", (length,)), "rd": Fold("rma", "d", (length,))},
            {"value": f"CASE WHEN ru IS NOT NULL THEN {strength('ru', 'rd')} END"},
        ],
        warmup=length + momentum,
    )


@operator()
def cci(cci_len=20, avg_len=3):
    n = cci_len
    spread = " + ".join(f"abs({f'lag(tp, {k}) {P}' if k else 'tp'} - m)" for k in range(n))
    return op(
        [
            {"m": since(f"avg(tp) {w(n)}", n)},
            {"mad": f"({spread}) / {n}"},
            {"raw": since(ratio("(tp - m)", "0.015 * mad", "0.0"), n)},
            {"value": Fold("ema", "raw", (avg_len,))},
            {"signal": Fold("ema", "value", (avg_len,))},
        ],
        ["value"],
        n,
    )


@operator("wpr")
def williams_r(wpr_len=14, avg_len=3):
    n = wpr_len
    return op(
        [
            {"hh": f"max(high) {w(n)}", "ll": f"min(low) {w(n)}"},
            {"raw": since(ratio("100 * (close - ll)", "hh - ll", "50.0"), n)},
            {"value": Fold("ema", "raw", (avg_len,))},
        ],
        ["value", "raw"],
        n,
    )


@operator()
def correlation_trend(length=20):
    n = length
    return op([{"s": f"stddev_pop(close) {w(n)}", "c": f"corr(close, i) {w(n)}"}, {"value": since("CASE WHEN s < 1e-12 THEN 0.0 ELSE c END", n)}], warmup=n)


@operator()
def laguerre_rsi(gamma=0.5):
    return op([{"value": Fold("laguerre_rsi", "close", (gamma,))}], warmup=2)


@operator()
def demarker(period=14):
    n = period
    return op(
        [
            {"u": f"greatest(high - lag(high, 1) {P}, 0.0) + 0 * pc", "d": f"greatest(lag(low, 1) {P} - low, 0.0) + 0 * pc"},
            {"su": f"sum(u) {w(n)}", "sd": f"sum(d) {w(n)}"},
            {"value": since(ratio("su", "su + sd", "0.5"), n + 1)},
        ],
        warmup=n + 1,
    )


@operator()
def squeeze_momentum(length=20, bb_mult=2.0, kc_length=20, kc_mult=1.5):
    n, first = length, length + max(length, kc_length) - 1
    return op(
        [
            {"m": f"avg(close) {w(n)}", "s": f"stddev_pop(close) {w(n)}", "r": f"avg(tr) {w(kc_length)}", "mid": f"(max(high) {w(n)} + min(low) {w(n)}) / 2"},
            {"x": since("close - (mid + m) / 2", n)},
            {"value": since(f"avg(x) {w(n)} + regr_slope(x, i) {w(n)} * {(n - 1) / 2!r}", first), "squeeze": since(f"CASE WHEN {bb_mult!r} * s < {kc_mult!r} * r THEN 1.0 ELSE 0.0 END", first)},
        ],
        ["value", "squeeze"],
        first,
    )


@operator()
def percent_rank(period=20):
    count = " + ".join(f"CASE WHEN lag(close, {k}) {P} <= close THEN 1 ELSE 0 END" for k in range(1, period + 1))
    return op([{"value": since(f"100.0 * ({count}) / {period}", period + 1)}], warmup=period + 1)


@operator()
def volume_zone_oscillator(period=14):
    return op(
        [
            {"x": "CASE WHEN pc IS NULL THEN NULL WHEN close > pc THEN volume WHEN close < pc THEN -volume ELSE 0.0 END", "v": "CASE WHEN pc IS NOT NULL THEN volume END"},
            {"a": Fold("ema", "x", (period,)), "b": Fold("ema", "v", (period,))},
            {"value": "CASE WHEN b IS NOT NULL THEN " + ratio("100 * a", "b", "0.0") + " END"},
        ],
        warmup=2,
    )


@operator()
def trend_relationship(fast_len=9, slow_len=21):
    return op([{"fast": Fold("ema", "close", (fast_len,)), "slow": Fold("ema", "close", (slow_len,))}, {"value": "fast - slow"}], ["value", "fast", "slow"])


@operator()
def vortex(period=14):
    n = period
    return op(
        [
            {"up": f"abs(high - lag(low, 1) {P})", "down": f"abs(low - lag(high, 1) {P})", "r": "CASE WHEN pc IS NOT NULL THEN tr END"},
            {"base": f"greatest(sum(r) {w(n)}, 1e-8)"},
            {"vi_plus": since(f"sum(up) {w(n)} / base", n + 1), "vi_minus": since(f"sum(down) {w(n)} / base", n + 1)},
            {"value": "vi_plus - vi_minus"},
        ],
        ["vi_plus", "vi_minus"],
        n + 1,
    )


@operator()
def aroon(period=14):
    n = period
    age = lambda f, x: f"(i - {f}(i, ROWOF({x}, i)) {w(n + 1)})"
    return op(
        [
            {"negative": "-low"},
            {"up_age": age("max_by", "high"), "down_age": age("max_by", "negative")},
            {"aroon_up": since(f"100.0 * ({n} - up_age) / {n}", n + 1), "aroon_down": since(f"100.0 * ({n} - down_age) / {n}", n + 1)},
            {"oscillator": "aroon_up - aroon_down"},
        ],
        ["aroon_up", "aroon_down", "oscillator"],
        n + 1,
    )


@operator("chop")
def choppiness(period=14):
    n = period
    return op(
        [{"span": f"max(high) {w(n)} - min(low) {w(n)}", "path": f"sum(tr) {w(n)}"}, {"value": since(f"CASE WHEN span > 0 AND path > 0 THEN least(100.0, greatest(0.0, 100 * log10(path / nullif(span, 0)) / {math.log10(n)!r})) END", n)}],
        warmup=n,
    )
