"""More operators with infinite memory."""

from __future__ import annotations

from .averages import op
from .oscillators import _gains, ratio
from .spec import CUM, Fold, P, operator, since, w


@operator("fisher")
def fisher_transform(fish_len=10, avg_len=2):
    n = fish_len
    return op(
        [
            {"hh": f"max(hl2) {w(n)}", "ll": f"min(hl2) {w(n)}"},
            {"place": since("CASE WHEN hh = ll THEN 0.0 ELSE (hl2 - ll) / nullif(hh - ll, 0) - 0.5 END", n)},
            {"raw": Fold("fisher", "close,place")},
            {"value": Fold("ema", "raw", (avg_len,))},
            {"signal": Fold("ema", "value", (3,))},
        ],
        ["value", "signal"],
        n,
    )


@operator()
def most(length=3, percent=2.0):
    return op(
        [{"ema": Fold("ema", "close", (length,))}, {"value": Fold("trailing_percent", "ema", (percent, "stop")), "direction": Fold("trailing_percent", "ema", (percent, "direction"))}],
        ["value", "ema", "direction"],
        2,
    )


@operator()
def cusum(len=20, k=0.5):
    return op([{"r": "close / pc - 1"}, {"value": Fold("cusum", "r", (len, k, "upper")), "lower": Fold("cusum", "r", (len, k, "lower"))}], ["value", "lower"], len + 2)


@operator()
def roofing_filter(hp_period=48, lp_period=10):
    return op([{"h": Fold("high_pass", "close", (hp_period,))}, {"s": Fold("super_smoother", "h", (lp_period,))}, {"value": since("s", hp_period)}], warmup=hp_period)


@operator("ce")
def chandelier_exit(length=22, atr_mult=3.0):
    n = length
    state = ("stop_side", "close,long_stop,short_stop", ())
    return op(
        [
            {"hh": f"max(high) {w(n)}", "ll": f"min(low) {w(n)}"},
            {"atr": Fold("rma", "tr", (n,))},
            {"a": f"hh - {atr_mult!r} * atr", "b": f"ll + {atr_mult!r} * atr"},
            {"long_stop": Fold("held_stop", "a,close", (1.0,)), "short_stop": Fold("held_stop", "b,close", (-1.0,))},
            {"direction": Fold(*state, 0), "value": Fold(*state, 1), "secondary": Fold(*state, 2)},
        ],
        ["value", "secondary", "direction", "long_stop", "short_stop"],
        n,
    )


@operator("cks")
def chande_kroll(atr_len=10, stop_len=9, mult=3.0):
    first = atr_len + stop_len - 1
    return op(
        [
            {"hh": f"max(high) {w(atr_len)}", "ll": f"min(low) {w(atr_len)}"},
            {"atr": Fold("rma", "tr", (atr_len,))},
            {"a": f"hh - {mult!r} * atr", "b": f"ll + {mult!r} * atr"},
            {"stop_long": since(f"max(a) {w(stop_len)}", first), "stop_short": since(f"min(b) {w(stop_len)}", first)},
        ],
        ["stop_long", "stop_short"],
        first,
    )


@operator("wt")
def wavetrend(n1=10, n2=21):
    return op(
        [
            {"m": Fold("ema", "tp", (n1,))},
            {"dev": "abs(tp - m)"},
            {"d": Fold("ema", "dev", (n1,))},
            {"ci": ratio("tp - m", "0.015 * d", "0.0")},
            {"wt1": Fold("ema", "ci", (n2,))},
            {"value": since("wt1", 4), "wt2": since(f"avg(wt1) {w(4)}", 4)},
            {"hist": "value - wt2"},
        ],
        ["value", "wt2", "hist"],
        4,
    )


@operator()
def pmo(length_1=35, length_2=20, signal_len=10):
    return op(
        [
            {"r": "100 * (close / pc - 1)"},
            {"a": Fold("alpha_ema", "r", (2 / length_1,))},
            {"b": "10 * a"},
            {"c": Fold("alpha_ema", "b", (2 / length_2,))},
            {"value": since("c", length_1 + length_2)},
            {"signal": Fold("ema", "value", (signal_len,))},
        ],
        ["value", "signal"],
        length_1 + length_2,
    )


@operator()
def alligator():
    """Three Wilder means of the middle price, each as it was some bars ago; the shifts grow from none at the first output."""
    shifted = lambda x, n: since(f"CASE WHEN i >= {13 + n} THEN lag({x}, {n}) {P} ELSE max(CASE WHEN i = 13 THEN {x} END) {CUM} END", 13)
    return op(
        [
            {"j": Fold("rma", "hl2", (13,)), "t": Fold("rma", "hl2", (8,)), "l": Fold("rma", "hl2", (5,))},
            {"jaw": shifted("j", 8), "teeth": shifted("t", 5), "lips": shifted("l", 3)},
            {"value": "lips"},
        ],
        ["value", "jaw", "teeth", "lips"],
        13,
    )


@operator("trmf")
def true_range_money_flow(period=21, volume_cap=2.5):
    """Range-located volume over volume, both capped at a multiple of the volume's mean before and smoothed."""
    return op(
        [
            {"m": Fold("alpha_ema", "volume", (1 / period,))},
            {"cap": f"least(volume, {volume_cap!r} * lag(m, 1) {P})" if volume_cap else "volume", "top": "CASE WHEN pc IS NOT NULL THEN greatest(high, pc) END", "bottom": "CASE WHEN pc IS NOT NULL THEN least(low, pc) END"},
            {"x": "CASE WHEN pc IS NULL THEN NULL WHEN top = bottom THEN 0.0 ELSE cap * (2 * (close - bottom) / nullif(top - bottom, 0) - 1) END", "v": "CASE WHEN pc IS NOT NULL THEN cap END"},
            {"a": Fold("rma", "x", (period,)), "b": Fold("rma", "v", (period,))},
            {"value": "CASE WHEN b > 0 THEN a / b END"},
        ],
        warmup=period + 1,
    )


@operator("kvo")
def klinger(fast_len=34, slow_len=55, signal_len=13):
    """Volume force by the trend of the typical sum, between two means.

    Ranges add up while the trend holds; a turn starts with the last bar's range and this one's. Equal sums keep the trend,
    and the first bar counts as rising.
    """
    island = "OVER (PARTITION BY series, {} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return op(
        [
            {"dm": "high - low", "hlc": "high + low + close", "pdm": f"lag(high - low, 1) {P}"},
            {"before": f"lag(hlc, 1) {P}"},
            {"moved": "CASE WHEN before IS NULL THEN 1 WHEN hlc > before THEN 1 WHEN hlc < before THEN -1 END"},
            {"moves": f"count(moved) {CUM}"},
            {"trend": f"max(moved) {island.format('moves')}"},
            {"turn": f"CASE WHEN trend <> lag(trend, 1) {P} THEN 1 ELSE 0 END"},
            {"leg": f"sum(turn) {CUM}"},
            {"cm": f"sum(CASE WHEN turn = 1 THEN dm + pdm ELSE dm END) {island.format('leg')}"},
            {"vf": "100 * volume * trend * abs(2 * CASE WHEN cm > 2.220446049250313e-16 THEN dm / cm ELSE 0.0 END - 1)"},
            {"f": Fold("ema", "vf", (fast_len,)), "s": Fold("ema", "vf", (slow_len,))},
            {"value": since("f - s", slow_len), "volume_force": since("vf", slow_len)},
            {"signal": Fold("ema", "value", (signal_len,))},
            {"hist": "value - signal"},
        ],
        ["value", "signal", "hist", "volume_force"],
        slow_len,
    )


@operator()
def qqe(rsi_len=14, smoothing=5, factor=4.236):
    """The smoothed RSI and its trail between bands of the doubly smoothed size of its moves."""
    n = 2 * rsi_len - 1
    state = ("band_trail", "m,width", ())
    return op(
        [
            *_gains(rsi_len),
            {"m": Fold("ema", "raw", (smoothing,))},
            {"move": f"abs(m - lag(m, 1) {P})"},
            {"m1": Fold("ema", "move", (n,))},
            {"m2": Fold("ema", "m1", (n,))},
            {"width": f"{factor!r} * m2"},
            {"trail": Fold(*state, 0), "trend": Fold(*state, 1)},
            {"value": since("m", rsi_len + 2), "band": since("width", rsi_len + 2)},
        ],
        ["value", "band", "trail", "trend"],
        rsi_len + 2,
    )


@operator()
def multi_factor(period=14):
    """Weighted trend, momentum and pressure, halved in a squeeze."""
    from .structure import _pressure, trend_quality

    n = period
    quality = [{("quality" if c == "value" else c): e for c, e in s.items()} for s in trend_quality(n).stages]
    return op(
        [
            *quality,
            *_gains(n),
            *_pressure(n),
            {"dev": f"stddev_pop(close) {w(n)}", "rng": f"avg(tr) {w(n)}"},
            {"squeezed": "CASE WHEN 2 * dev < 1.5 * rng THEN 0.5 ELSE 1.0 END", "rsi_factor": "2 * (raw - 50)"},
            {"value": since("squeezed * (0.35 * quality + 0.25 * rsi_factor + 0.4 * smooth_pressure)", 2 * n)},
        ],
        ["value"],
        2 * n,
    )
