"""Cycle filters, kernel regression, profiles and other rolling read-outs."""

from __future__ import annotations

import math

from .averages import op
from .oscillators import ratio, strength
from .spec import CUM, Fold, P, operator, since, w


@operator()
def ultimate_smoother(period=20):
    return op([{"s": Fold("ultimate_smoother", "close", (period,))}, {"value": since("s", period)}], warmup=period)


@operator()
def cyber_cycle(alpha=0.07):
    return op([{"c": Fold("cyber_cycle", "hl2", (alpha,))}, {"value": since("c", 30), "trigger": since(f"lag(c, 1) {P}", 30)}], ["value", "trigger"], 30)


@operator()
def reflex(length=20):
    return op([{"value": Fold("reflex", "close", (length, True))}], warmup=length + 1)


@operator()
def trendflex(length=20):
    return op([{"value": Fold("reflex", "close", (length, False))}], warmup=length + 1)


@operator()
def frama(period=16):
    return op([{"value": Fold("frama", "hl2,high,low", (period, "line")), "dimension": Fold("frama", "hl2,high,low", (period, "dimension"))}], ["value", "dimension"], period + 1)


@operator()
def rci(len=9):
    return op([{"value": Fold("rank_correlation", "close", (len,))}], warmup=len)


@operator()
def hurst_rs(period=128, min_chunk=8):
    return op([{"r": "ln(close / pc)"}, {"value": Fold("hurst", "r", (period, min_chunk))}], warmup=period + 1)


@operator()
def range_filter(period=100, mult=3.0):
    return op(
        [
            {"d": "abs(close - pc)"},
            {"a": Fold("ema", "d", (period,))},
            {"b": Fold("ema", "a", (2 * period - 1,))},
            {"band": f"{mult!r} * b"},
            {"value": Fold("range_filter", "close,band", ("line",)), "direction": Fold("range_filter", "close,band", ("direction",))},
            {"upper": "value + band", "lower": "value - band"},
        ],
        ["value", "direction", "upper", "lower"],
        2,
    )


@operator("vp")
def volume_profile(lookback=70, num_bins=30):
    source = "high,low,volume"
    return op(
        [{c: Fold("volume_profile", source, (lookback, num_bins, k)) for c, k in (("value", "poc"), ("vah", "high"), ("val", "low"))}],
        ["value", "vah", "val"],
        lookback,
    )


@operator()
def tpo_profile(lookback=48, num_bins=30):
    """As the volume profile, with every bar counting the same."""
    return op(
        [{"one": "1.0 + 0 * close"}, {c: Fold("volume_profile", "high,low,one", (lookback, num_bins, k)) for c, k in (("value", "poc"), ("vah", "high"), ("val", "low"))}],
        ["value", "vah", "val"],
        lookback,
    )


@operator()
def mfi(mfi_len=14, avg_len=3):
    n = mfi_len
    return op(
        [
            {"pt": f"lag(tp, 1) {P}"},
            {"u": "CASE WHEN tp > pt THEN tp * volume ELSE 0.0 END", "d": "CASE WHEN tp < pt THEN tp * volume ELSE 0.0 END"},
            {"su": f"sum(u) {w(n)}", "sd": f"sum(d) {w(n)}"},
            {"raw": since(strength("su", "sd"), n)},
            {"value": Fold("ema", "raw", (avg_len,))},
            {"signal": Fold("ema", "value", (avg_len,))},
        ],
        ["value", "signal"],
        n,
    )


@operator()
def relative_volatility(stdev_len=10, smooth_len=14):
    return op(
        [
            {"s": since(f"stddev_pop(close) {w(stdev_len)}", stdev_len)},
            {"u": "CASE WHEN s IS NOT NULL THEN CASE WHEN close > pc THEN s ELSE 0.0 END END", "d": "CASE WHEN s IS NOT NULL THEN CASE WHEN close < pc THEN s ELSE 0.0 END END"},
            {"ru": Fold("rma", "u", (smooth_len,)), "rd": Fold("rma", "d", (smooth_len,))},
            {"value": "CASE WHEN ru IS NOT NULL THEN " + ratio("100 * ru", "ru + rd", "50.0") + " END"},
        ],
        warmup=stdev_len + smooth_len - 1,
    )


@operator()
def nadaraya_watson(bandwidth=8, lookback=50, mult=3.0):
    weights = [math.exp(-(k * k) / (2 * bandwidth * bandwidth)) for k in range(lookback)]
    line = " + ".join(f"{x / sum(weights)!r} * " + (f"lag(close, {k}) {P}" if k else "close") for k, x in enumerate(weights))
    first = 2 * lookback - 1
    return op(
        [
            {"y": since(line, lookback)},
            {"e": "abs(close - y)"},
            {"mae": f"avg(e) {w(lookback)}"},
            {"value": since("y", first), "upper": since(f"y + {mult!r} * mae", first), "lower": since(f"y - {mult!r} * mae", first)},
        ],
        ["value", "upper", "lower"],
        first,
    )


@operator()
def ssl_channel(period=10):
    """Means of highs and lows, exchanged while the last close beyond them was under the lower one."""
    return op(
        [
            {"sh": since(f"avg(high) {w(period)}", period), "sl": since(f"avg(low) {w(period)}", period)},
            {"side": "CASE WHEN close > sh THEN 1.0 WHEN close < sl THEN -1.0 END"},
            {"run": f"count(side) {CUM}"},
            {"hlv": "max(side) OVER (PARTITION BY series, run)"},
            {"value": "CASE WHEN hlv < 0 THEN sl WHEN hlv > 0 THEN sh END", "ssl_down": "CASE WHEN hlv < 0 THEN sh WHEN hlv > 0 THEN sl END"},
        ],
        ["value", "ssl_down", "hlv"],
        period,
    )


@operator("vfi")
def volume_flow_indicator(period=130, coef=0.2, vcoef=2.5, smoothing=3):
    return op(
        [
            {"inter": "ln(tp) - ln(lag(tp, 1) OVER (PARTITION BY series ORDER BY ts))"},
            {"vinter": f"stddev_pop(inter) {w(30)}", "vave": f"avg(volume) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN {period} PRECEDING AND 1 PRECEDING)", "mf": f"tp - lag(tp, 1) {P}"},
            {"cutoff": f"{coef!r} * vinter * close", "vc": f"least(volume, {vcoef!r} * vave)"},
            {"x": since("CASE WHEN mf > cutoff THEN vc WHEN mf < -cutoff THEN -vc ELSE 0.0 END", 31)},
            {"raw": since(ratio(f"sum(x) {w(period)}", "vave", "0.0"), 2 * period)},
            {"value": Fold("ema", "raw", (smoothing,))},
        ],
        ["value", "raw"],
        2 * period,
    )


@operator()
def fractal_dimension(period=30):
    """From the ranges of the window's halves and of the whole, clamped to 1..2."""
    n, h = period, period // 2
    return op(
        [
            {"h1": f"max(high) {w(h)}", "l1": f"min(low) {w(h)}", "h3": f"max(high) {w(n)}", "l3": f"min(low) {w(n)}"},
            {"h2": f"lag(h1, {h}) {P}", "l2": f"lag(l1, {h}) {P}"},
            {"a": f"(h1 - l1 + h2 - l2) / {h}", "b": f"(h3 - l3) / {n}"},
            {"value": since(f"CASE WHEN a > 0 AND b > 0 THEN least(2.0, greatest(1.0, (ln(a) - ln(b)) / {math.log(2)!r})) ELSE 1.0 END", n)},
        ],
        warmup=n,
    )


@operator()
def crossing_age(period=20):
    """Bars since the close last crossed its mean."""
    return op(
        [
            {"m": since(f"avg(close) {w(period)}", period)},
            {"side": "CASE WHEN close > m THEN 1 WHEN close < m THEN -1 END"},
            {"run": f"count(side) {CUM}"},
            {"held": "max(side) OVER (PARTITION BY series, run)"},
            {"crossed": f"CASE WHEN held <> lag(held, 1) {P} THEN i END"},
            {"last_cross": f"max(crossed) {CUM}"},
            {"bars_since_crossing": "i - last_cross"},
        ],
        ["bars_since_crossing"],
        period + 1,
    )
