"""Ordered recurrences over one series, as NumPy functions, and DuckDB forms of those that a list fold can express.

Inputs are float arrays in time order; NaN means no value yet. Leading NaNs are skipped (the recurrence starts at the first
value), a NaN further on leaves the state and gives no output.
"""

from __future__ import annotations

import math

import numpy as np

NAN = float("nan")


def _over(x: np.ndarray, step) -> np.ndarray:
    out = np.full(len(x), NAN)
    for k in range(len(x)):
        if not math.isnan(x[k]):
            out[k] = step(float(x[k]))
    return out


def alpha_ema(x: np.ndarray, alpha: float) -> np.ndarray:
    """Exponential mean that starts at the first sample."""
    state = [NAN]

    def step(v):
        state[0] = v if math.isnan(state[0]) else state[0] + alpha * (v - state[0])
        return state[0]

    return _over(x, step)


def ema(x: np.ndarray, n: int) -> np.ndarray:
    return alpha_ema(x, 2 / (n + 1))


def rma(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's mean: the plain mean of the first n, then weight 1/n; nothing before."""
    first: list[float] = []
    state = [NAN]

    def step(v):
        if len(first) < n:
            first.append(v)
            if len(first) == n:
                state[0] = sum(first) / n
            return state[0]
        state[0] += (v - state[0]) / n
        return state[0]

    return _over(x, step)


def kama(x: np.ndarray, n: int, fast: int, slow: int) -> np.ndarray:
    """Kaufman's adaptive mean; the state starts at the n-th close."""
    out, a, b = np.full(len(x), NAN), 2 / (fast + 1), 2 / (slow + 1)
    state = NAN
    for k in range(n, len(x)):
        path = np.abs(np.diff(x[k - n : k + 1])).sum()
        er = abs(x[k] - x[k - n]) / path if path > 0 else 0.0
        state = x[k] if math.isnan(state) else state + (er * (a - b) + b) ** 2 * (x[k] - state)
        out[k] = state
    return out


def super_smoother(x: np.ndarray, n: int) -> np.ndarray:
    """Two-pole Butterworth low-pass; the first two outputs are the inputs."""
    a = math.exp(-math.sqrt(2) * math.pi / n)
    c2, c3 = 2 * a * math.cos(math.sqrt(2) * math.pi / n), -a * a
    c1, out = 1 - c2 - c3, np.array(x, float)
    for k in range(2, len(x)):
        out[k] = c1 * (x[k] + x[k - 1]) / 2 + c2 * out[k - 1] + c3 * out[k - 2]
    return out


def mcginley(x: np.ndarray, n: int) -> np.ndarray:
    """McGinley's dynamic line from the first value on, with floors of 1e-8 on the line and 1e-6 on the divisor."""
    state = [NAN]

    def step(v):
        s = state[0]
        state[0] = v if math.isnan(s) else s + (v - s) / max(n * (v / max(s, 1e-8)) ** 4, 1e-6)
        return state[0]

    return _over(x, step)


def fisher(x: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Fisher transform of a place in the range (-0.5 to 0.5); both recursions start at 0."""
    out, value, fish = np.full(len(place), NAN), 0.0, 0.0
    for k in range(len(place)):
        if not math.isnan(place[k]):
            value = min(0.999, max(-0.999, 0.66 * place[k] + 0.67 * value))
            fish = 0.5 * math.log((1 + value) / (1 - value)) + 0.5 * fish
            out[k] = fish
    return out


def trailing_percent(x: np.ndarray, percent: float, want: str) -> np.ndarray:
    """A stop that trails a line by a percentage and tightens while the line stays beyond it; nothing before the first decision."""
    out, under, over, side = np.full(len(x), NAN), NAN, NAN, 0.0
    for k in range(len(x)):
        v = x[k]
        if math.isnan(v):
            continue
        low, high = v * (1 - percent / 100), v * (1 + percent / 100)
        if not math.isnan(under):
            if side < 1 and v > over:
                side = 1.0
            elif side > -1 and v < under:
                side = -1.0
            low = max(low, under) if v > under else low
            high = min(high, over) if v < over else high
        under, over = low, high
        if side:
            out[k] = side if want == "direction" else under if side > 0 else over
    return out


def cusum(x: np.ndarray, n: int, slack: float, want: str) -> np.ndarray:
    """Two-sided sums of standardised values beyond a slack, calibrated on the first n."""
    out, first, up, down = np.full(len(x), NAN), [], 0.0, 0.0
    for k in range(len(x)):
        if math.isnan(x[k]):
            continue
        if len(first) < n:
            first.append(x[k])
            continue
        mean, dev = float(np.mean(first)), float(np.std(first))
        z = (x[k] - mean) / dev if dev > 0 else 0.0
        up, down = max(0.0, up + z - slack), max(0.0, down - z - slack)
        out[k] = up if want == "upper" else down
    return out


def high_pass(x: np.ndarray, n: int) -> np.ndarray:
    """Two-pole high-pass; 0 for the first two values."""
    a = math.cos(0.707 * 2 * math.pi / n)
    alpha = (a + math.sin(0.707 * 2 * math.pi / n) - 1) / a
    out = np.zeros(len(x))
    for k in range(2, len(x)):
        out[k] = (1 - alpha / 2) ** 2 * (x[k] - 2 * x[k - 1] + x[k - 2]) + 2 * (1 - alpha) * out[k - 1] - (1 - alpha) ** 2 * out[k - 2]
    return out


def held_stop(extreme: np.ndarray, close: np.ndarray, side: float) -> np.ndarray:
    """A stop that only tightens while the last close stayed on its side; side 1 for stops under the price."""
    out, held = np.full(len(extreme), NAN), NAN
    for k in range(len(extreme)):
        if math.isnan(extreme[k]):
            continue
        inside = not math.isnan(held) and k and (close[k - 1] - held) * side > 0
        held = (max(extreme[k], held) if side > 0 else min(extreme[k], held)) if inside else extreme[k]
        out[k] = held
    return out


def vidya(x: np.ndarray, cmo_len: int, n: int) -> np.ndarray:
    out, state = np.full(len(x), NAN), NAN
    for k in range(cmo_len, len(x)):
        d = np.diff(x[k - cmo_len : k + 1])
        total = np.abs(d).sum()
        share = abs(d.sum()) / total if total > 0 else 0.0
        state = x[k] if math.isnan(state) else state + 2 / (n + 1) * share * (x[k] - state)
        out[k] = state
    return out


def laguerre_rsi(x: np.ndarray, gamma: float) -> np.ndarray:
    out, stages, held = np.full(len(x), NAN), [x[0]] * 4 if len(x) else [], NAN
    for k in range(len(x)):
        old = list(stages)
        stages[0] = (1 - gamma) * x[k] + gamma * old[0]
        for j in range(1, 4):
            stages[j] = -gamma * stages[j - 1] + old[j - 1] + gamma * old[j]
        d = [stages[j] - stages[j + 1] for j in range(3)]
        up, down = sum(v for v in d if v > 0), -sum(v for v in d if v < 0)
        if up + down > 0:
            held = up / (up + down)
        if k:
            out[k] = held
    return out


def supertrend(high: np.ndarray, low: np.ndarray, close: np.ndarray, atr: np.ndarray, mult: float, want: str) -> np.ndarray:
    """Ratcheting bands around the mid price; the trend flips on a close beyond the band. `want`: line, trend, upper, lower."""
    out = np.full(len(close), NAN)
    up = down = NAN
    trend = 1.0
    for k in range(len(close)):
        if math.isnan(atr[k]):
            continue
        mid = (high[k] + low[k]) / 2
        a, b = mid + mult * atr[k], mid - mult * atr[k]
        if not math.isnan(up):
            a = a if a < up or close[k - 1] > up else up
            b = b if b > down or close[k - 1] < down else down
            trend = -1.0 if trend > 0 and close[k] < b else 1.0 if trend < 0 and close[k] > a else trend
        up, down = a, b
        out[k] = {"line": b if trend > 0 else a, "trend": trend, "upper": a, "lower": b}[want]
    return out


def parabolic_sar(high: np.ndarray, low: np.ndarray, step: float, most: float, want: str) -> np.ndarray:
    """Wilder's stop and reverse, held outside the two bars before. `want`: sar, trend."""
    n = len(high)
    out = np.full(n, NAN)
    if not n:
        return out
    rising, af, extreme, sar = True, step, high[0], low[0]
    for k in range(n):
        if k:
            sar += af * (extreme - sar)
            before = slice(max(0, k - 2), k)
            sar = min(sar, low[before].min()) if rising else max(sar, high[before].max())
            if rising and low[k] < sar or not rising and high[k] > sar:
                rising, sar, af = not rising, extreme, step
                extreme = high[k] if rising else low[k]
            else:
                new = max(extreme, high[k]) if rising else min(extreme, low[k])
                if new != extreme:
                    extreme, af = new, min(af + step, most)
        out[k] = sar if want == "sar" else 1.0 if rising else -1.0
    return out


def ultimate_smoother(x: np.ndarray, n: int) -> np.ndarray:
    """Ehlers' unity-gain two-pole smoother; the first three outputs are the inputs."""
    a = math.exp(-1.414 * math.pi / n)
    c2, c3 = 2 * a * math.cos(1.414 * math.pi / n), -a * a
    c1, out = (1 + c2 - c3) / 4, np.array(x, float)
    for k in range(3, len(x)):
        out[k] = (1 - c1) * x[k] + (2 * c1 - c2) * x[k - 1] - (c1 + c3) * x[k - 2] + c2 * out[k - 1] + c3 * out[k - 2]
    return out


def cyber_cycle(x: np.ndarray, alpha: float) -> np.ndarray:
    """Ehlers' cycle of a four-tap smooth; a plain second difference for the first six values."""
    out, n = np.zeros(len(x)), len(x)
    smooth = np.array(x, float)
    for k in range(3, n):
        smooth[k] = (x[k] + 2 * x[k - 1] + 2 * x[k - 2] + x[k - 3]) / 6
    for k in range(2, n):
        if k < 6:
            out[k] = (x[k] - 2 * x[k - 1] + x[k - 2]) / 4
        else:
            out[k] = (1 - alpha / 2) ** 2 * (smooth[k] - 2 * smooth[k - 1] + smooth[k - 2]) + 2 * (1 - alpha) * out[k - 1] - (1 - alpha) ** 2 * out[k - 2]
    return out


def reflex(x: np.ndarray, n: int, slope: bool) -> np.ndarray:
    """Mean deviation of a smoothed line from its chord (or from its present value), over its running size."""
    line, out, square = super_smoother(x, max(2, n // 2)), np.full(len(x), NAN), 0.0
    steps = np.arange(1, n + 1)
    for k in range(n, len(x)):
        tilt = (line[k - n] - line[k]) / n if slope else 0.0
        total = float((line[k] + steps * tilt - line[k - n : k][::-1]).sum() / n)
        square = 0.04 * total * total + 0.96 * square
        out[k] = total / math.sqrt(square) if square > 0 else 0.0
    return out


def frama(price: np.ndarray, high: np.ndarray, low: np.ndarray, n: int, want: str) -> np.ndarray:
    """Fractal adaptive mean: the weight follows the dimension of the last n bars' ranges and their halves'."""
    out, state, half = np.full(len(price), NAN), NAN, n // 2
    for k in range(n, len(price)):
        h, l = high[k - n + 1 : k + 1], low[k - n + 1 : k + 1]
        parts = [(a.max() - b.min()) / s for a, b, s in ((h[:half], l[:half], half), (h[half:], l[half:], half), (h, l, n))]
        dimension = (math.log(parts[0] + parts[1]) - math.log(parts[2])) / math.log(2) if min(parts[0] + parts[1], parts[2]) > 0 else 1.0
        alpha = min(1.0, max(0.01, math.exp(-4.6 * (dimension - 1))))
        state = price[k] if math.isnan(state) else state + alpha * (price[k] - state)
        out[k] = state if want == "line" else dimension
    return out


def rank_correlation(x: np.ndarray, n: int) -> np.ndarray:
    """100 times the correlation of average-tie ranks with time over the last n; 0 if flat."""
    out, time = np.full(len(x), NAN), np.arange(n) - (n - 1) / 2
    for k in range(n - 1, len(x)):
        part = x[k - n + 1 : k + 1]
        ranks = (part[:, None] > part[None, :]).sum(axis=1) + (part[:, None] == part[None, :]).sum(axis=1) / 2
        ranks = ranks - ranks.mean()
        size = math.sqrt((ranks**2).sum() * (time**2).sum())
        out[k] = 100 * float((ranks * time).sum()) / size if size > 0 else 0.0
    return out


def hurst(x: np.ndarray, n: int, least: int) -> np.ndarray:
    """Slope of log R/S against log chunk size over chunks that double from `least`, in the last n returns."""
    out, sizes = np.full(len(x), NAN), []
    s = least
    while s <= n:
        sizes.append(s)
        s *= 2
    for k in range(len(x)):
        r = x[max(0, k - n + 1) : k + 1]
        if len(r) < n or np.isnan(r).any():
            continue
        points = []
        for s in sizes:
            c = r[: n // s * s].reshape(-1, s)
            walk = np.cumsum(c - c.mean(axis=1, keepdims=True), axis=1)
            dev = c.std(axis=1)
            ok = dev > 0
            if ok.any():
                points.append((math.log(s), math.log(((walk.max(axis=1) - walk.min(axis=1))[ok] / dev[ok]).mean())))
        if len(points) > 1:
            a, b = np.array(points).T
            out[k] = ((a - a.mean()) * (b - b.mean())).sum() / ((a - a.mean()) ** 2).sum()
    return out


def range_filter(x: np.ndarray, band: np.ndarray, want: str) -> np.ndarray:
    """A line that moves only when the price leaves its band; direction of its last move."""
    out, line, side = np.full(len(x), NAN), NAN, 0.0
    for k in range(len(x)):
        if math.isnan(band[k]):
            continue
        old = line
        line = x[k] if math.isnan(line) else max(line, x[k] - band[k]) if x[k] > line else min(line, x[k] + band[k])
        tolerance = 1e-9 * max(1.0, abs(line))
        if not math.isnan(old) and abs(line - old) > tolerance:
            side = 1.0 if line > old else -1.0
        out[k] = line if want == "line" else side
    return out


def volume_profile(high: np.ndarray, low: np.ndarray, volume: np.ndarray, n: int, bins: int, want: str) -> np.ndarray:
    """Volume by price over the last n bars, each spread evenly over its range: point of control, or a bound of the 70 % value area."""
    out = np.full(len(high), NAN)
    for k in range(n - 1, len(high)):
        h, l, v = high[k - n + 1 : k + 1], low[k - n + 1 : k + 1], volume[k - n + 1 : k + 1]
        bottom, top = l.min(), h.max()
        if not top > bottom:
            continue
        edges = np.linspace(bottom, top, bins + 1)
        overlap = np.minimum(h[:, None], edges[None, 1:]) - np.maximum(l[:, None], edges[None, :-1])
        share = np.where((h > l)[:, None], np.clip(overlap, 0, None) / np.where(h > l, h - l, 1)[:, None], ((l[:, None] >= edges[None, :-1]) & ((l[:, None] < edges[None, 1:]) | (np.arange(bins) == bins - 1))))
        held = (share * v[:, None]).sum(axis=0)
        a = b = int(np.argmax(held))
        width = (top - bottom) / bins
        if want == "poc":
            out[k] = edges[a] + width / 2
            continue
        inside = held[a]
        while inside < 0.7 * held.sum() and (a > 0 or b < bins - 1):
            up, down = held[b + 1] if b < bins - 1 else -1.0, held[a - 1] if a > 0 else -1.0
            if up >= down:
                b, inside = b + 1, inside + up
            else:
                a, inside = a - 1, inside + down
        out[k] = edges[b + 1] if want == "high" else edges[a]
    return out


KERNELS = {f.__name__: f for f in (alpha_ema, ema, rma, kama, super_smoother, mcginley, vidya, fisher, trailing_percent, cusum, high_pass, held_stop, ultimate_smoother, cyber_cycle, reflex, frama, rank_correlation, hurst, range_filter, volume_profile, laguerre_rsi, supertrend, parabolic_sar)}

_CUM = "OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _list(x: str) -> str:
    return f"(list({x}) FILTER (WHERE {x} IS NOT NULL) {_CUM})"


def _alpha_sql(x: str, alpha: float) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN list_reduce({_list(x)}, lambda a, b: a + {alpha!r} * (b - a)) END"


def _rma_sql(x: str, n: int) -> str:
    seed = f"list_avg({_list(x)}[1:{n}])"
    return f"CASE WHEN {x} IS NOT NULL AND len({_list(x)}) >= {n} THEN list_reduce(list_prepend({seed}, {_list(x)}[{n + 1}:]), lambda a, b: a + (b - a) / {n}) END"


SQL = {"alpha_ema": _alpha_sql, "ema": lambda x, n: _alpha_sql(x, 2 / (n + 1)), "rma": _rma_sql}
