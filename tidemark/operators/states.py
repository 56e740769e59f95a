"""State machines over one series, as NumPy functions that return all their lines at once.

Inputs are float arrays in time order; NaN means no value. Pivots, extremes and means come ready from window expressions,
so a machine keeps a few numbers only.
"""

from __future__ import annotations

import math

import numpy as np

NAN = float("nan")


def _lines(n: int, count: int) -> list[np.ndarray]:
    return [np.full(n, NAN) for _ in range(count)]


def zigzag_legs(high_pivot: np.ndarray, low_pivot: np.ndarray, deviation: float) -> list[np.ndarray]:
    """Price of the newest node and its side (1 a high, -1 a low, 0 and 0 before any), by confirmed pivots.

    A pivot of the newest node's side moves it outwards; one of the other side adds a node if it lies beyond the node by
    `deviation` percent of its price. Where a bar is both, the newest side goes first, and without a node none starts.
    """
    price, side = 0.0, 0
    out = _lines(len(high_pivot), 2)
    for k, (h, low) in enumerate(zip(high_pivot, low_pivot, strict=True)):
        found = [(s, p) for s, p in ((1, h), (-1, low)) if not math.isnan(p)]
        if len(found) == 2:
            found = [] if not side else sorted(found, key=lambda x: x[0] != side)
        for s, p in found:
            move = (p - price) * s
            if s == side:
                price = p if move > 0 else price
            elif not side or (move > 0 and (price == 0 or move / abs(price) >= deviation / 100)):
                price, side = p, s
        out[0][k], out[1][k] = price, side
    return out


def pivot_score(high_pivot: np.ndarray, low_pivot: np.ndarray, window: int) -> list[np.ndarray]:
    """-100..100: the last `window` comparisons of pivots with the pivot of their kind before, by weights 2, -1, 1, -2."""
    last = [NAN, NAN]
    scores: list[float] = []
    out = _lines(len(high_pivot), 1)
    for k, pair in enumerate(zip(high_pivot, low_pivot, strict=True)):
        total, compared = 0.0, False
        for kind, (p, up, down) in enumerate(zip(pair, (2.0, 1.0), (-1.0, -2.0), strict=True)):
            if math.isnan(p):
                continue
            if not math.isnan(last[kind]):
                total, compared = total + (up if p > last[kind] else down), True
            last[kind] = p
        if compared:
            scores = [*scores, total][-window:]
        out[0][k] = min(100.0, max(-100.0, 100 * sum(scores) / (2 * window)))
    return out


def structure_breaks(close: np.ndarray, high_pivot: np.ndarray, low_pivot: np.ndarray) -> list[np.ndarray]:
    """Event (1 break upwards in an uptrend, 2 break that turns it, negative downwards, else 0), trend, and broken level.

    A close beyond the newest pivot breaks it, and a broken pivot is gone until the next one. If both break on one bar, the
    low's event stands.
    """
    levels, trend = [NAN, NAN], 0
    out = _lines(len(close), 3)
    for k, c in enumerate(close):
        event, level = 0.0, NAN
        for kind, p in enumerate((high_pivot[k], low_pivot[k])):
            if not math.isnan(p):
                levels[kind] = p
        for kind, side in enumerate((1, -1)):
            if (c - levels[kind]) * side > 0:
                event, level = side * (1.0 if trend == side else 2.0), levels[kind]
                trend, levels[kind] = side, NAN
        out[0][k], out[1][k], out[2][k] = event, trend, level
    return out


def level_sweeps(high: np.ndarray, low: np.ndarray, close: np.ndarray, high_pivot: np.ndarray, low_pivot: np.ndarray, tolerance: float, most: int) -> list[np.ndarray]:
    """Sweep (-1 a high pierced and given back, 1 a low), and the pairs of neighbouring levels equal within a tolerance in percent.

    The newest `most` pivots of each kind are levels; one that a bar trades beyond is gone.
    """
    highs: list[float] = []
    lows: list[float] = []
    out = _lines(len(close), 3)
    near = lambda levels: sum(abs(a - b) / a * 100 <= tolerance for a, b in zip(levels, levels[1:]))
    for k, (h, low_, c) in enumerate(zip(high, low, close, strict=True)):
        if not math.isnan(high_pivot[k]):
            highs = [*highs, high_pivot[k]][-most:]
        if not math.isnan(low_pivot[k]):
            lows = [*lows, low_pivot[k]][-most:]
        swept = -1.0 if any(c < x < h for x in highs) else 1.0 if any(low_ < x < c for x in lows) else 0.0
        highs, lows = [x for x in highs if h <= x], [x for x in lows if low_ >= x]
        out[0][k], out[1][k], out[2][k] = swept, near(highs), near(lows)
    return out


def band_trail(line: np.ndarray, width: np.ndarray) -> list[np.ndarray]:
    """Trail and trend of a line between two bands that ratchet towards it while it keeps to their side."""
    under = over = before = NAN
    trend = 0
    out = _lines(len(line), 2)
    for k, (m, d) in enumerate(zip(line, width, strict=True)):
        if math.isnan(m):
            continue
        if not math.isnan(d):
            low, high = m - d, m + d
            if not math.isnan(under):
                slack = lambda level: 1e-9 * max(abs(m), abs(level), 1.0)
                if trend != 1 and m > over + slack(over):
                    trend = 1
                elif trend != -1 and m < under - slack(under):
                    trend = -1
                low = max(low, under) if min(before, m) > under else low
                high = min(high, over) if max(before, m) < over else high
            under, over = low, high
            out[0][k], out[1][k] = (under if trend == 1 else over if trend == -1 else m), trend
        before = m
    return out


def stop_side(close: np.ndarray, long_stop: np.ndarray, short_stop: np.ndarray) -> list[np.ndarray]:
    """Direction, its stop and the other one: a close beyond one side's last stop turns, beyond both it does not."""
    side, a, b = 1.0, NAN, NAN
    out = _lines(len(close), 3)
    for k, c in enumerate(close):
        if math.isnan(long_stop[k]):
            continue
        last_long, last_short = (long_stop[k], short_stop[k]) if math.isnan(a) else (a, b)
        up, down = c > last_short, c < last_long
        side = 1.0 if up and not down else -1.0 if down and not up else side
        a, b = long_stop[k], short_stop[k]
        out[0][k], out[1][k], out[2][k] = side, *((a, b) if side > 0 else (b, a))
    return out


def smoothed_place(x: np.ndarray, low: np.ndarray, high: np.ndarray, scale: np.ndarray, factor: float, least: float, flat: float) -> list[np.ndarray]:
    """The place of a line in its range (0..100), smoothed; in a range without height the last place, or `flat` (NaN: the line)."""
    place = value = NAN
    out = _lines(len(x), 1)
    for k, v in enumerate(x):
        if math.isnan(v) or math.isnan(low[k]):
            continue
        if high[k] - low[k] > least * max(abs(scale[k]), 1.0):
            place = 100 * (v - low[k]) / (high[k] - low[k])
        elif math.isnan(place):
            place = v if math.isnan(flat) else flat
        value = place if math.isnan(value) else value + factor * (place - value)
        out[0][k] = value
    return out


def weighted_mean(x: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """A mean that starts at the first value and moves by a weight of its own at each."""
    value = NAN
    out = _lines(len(x), 1)
    for k, v in enumerate(x):
        value = v if math.isnan(value) else weight[k] * v + (1 - weight[k]) * value
        out[0][k] = value
    return out


def half_trend(high: np.ndarray, low: np.ndarray, close: np.ndarray, top: np.ndarray, bottom: np.ndarray, mean_high: np.ndarray, mean_low: np.ndarray) -> list[np.ndarray]:
    """Line and trend: the trend turns down when the mean high falls under the highest recorded low and the close under the
    last low, and up by the mirror rule; the line ratchets with the trend and goes on from the other side's on a turn."""
    trend, line = 0, NAN
    best_low = best_high = NAN
    out = _lines(len(close), 2)
    for k in range(1, len(close)):
        if math.isnan(top[k]):
            continue
        if math.isnan(best_low):
            best_low, best_high = low[k - 1], high[k - 1]
        before = trend
        if before >= 0:
            best_low = max(bottom[k], best_low)
        if before <= 0:
            best_high = min(top[k], best_high)
        if before >= 0 and mean_high[k] < best_low and close[k] < low[k - 1]:
            trend, best_high = -1, top[k]
        elif before <= 0 and mean_low[k] > best_high and close[k] > high[k - 1]:
            trend, best_low = 1, bottom[k]
        if trend and not before:
            line = best_low if trend > 0 else best_high
        elif trend and trend == before:
            line = max(best_low, line) if trend > 0 else min(best_high, line)
        out[0][k], out[1][k] = (line if trend else NAN), trend
    return out


def countdown(setup: np.ndarray, high: np.ndarray, low: np.ndarray, close: np.ndarray, high2: np.ndarray, low2: np.ndarray) -> list[np.ndarray]:
    """Signed countdown after a setup of nine: bars that close at or beyond the extreme of two bars before count up to
    twelve, and the thirteenth must also reach the eighth one's close."""
    side, count, eighth = 0, 0, NAN
    out = _lines(len(close), 1)
    for k, s in enumerate(setup):
        if math.isnan(s):
            continue
        if abs(s) == 9 and side != np.sign(s):
            side, count = int(np.sign(s)), 0
        if side and (close[k] >= high2[k] if side > 0 else close[k] <= low2[k]):
            if count < 12:
                count += 1
                eighth = close[k] if count == 8 else eighth
            elif high[k] >= eighth if side > 0 else low[k] <= eighth:
                count = 13
        out[0][k] = side * count
        if count == 13:
            side, count = 0, 0
    return out


def filtered_stops(opened: np.ndarray, close: np.ndarray, raw_long: np.ndarray, raw_short: np.ndarray, atr: np.ndarray, mean: np.ndarray, body: float, danger: float, warn: float) -> list[np.ndarray]:
    """Stop of the direction, long and short stop, distance in ATR to the last stop, and risk state (1 near to 3 far, signed).

    The direction's stop only tightens; it turns on a close beyond the other side's last stop if the bar's body is large
    enough. A close on the wrong side of a short mean makes a far state a middle one.
    """
    side, a, b = 1, NAN, NAN
    out = _lines(len(close), 5)
    for k, c in enumerate(close):
        if math.isnan(raw_long[k]):
            continue
        was_a, was_b = (raw_long[k], raw_short[k]) if math.isnan(a) else (a, b)
        a = max(raw_long[k], was_a) if side > 0 else raw_long[k]
        b = min(raw_short[k], was_b) if side < 0 else raw_short[k]
        up, down = c > was_b, c < was_a
        if up != down and (body <= 0 or abs(c - opened[k]) >= body * atr[k]):
            side = 1 if up else -1
        away = abs(c - (was_a if side > 0 else was_b)) / atr[k] if atr[k] else 0.0
        near = away < max(warn, danger + 0.05) or (mean[k] - c) * side > 0
        risk = side * (1 if away < danger else 2 if near else 3)
        for line, v in zip(out, (a if side > 0 else b, a, b, away, risk), strict=True):
            line[k] = v
    return out


def open_gaps(high: np.ndarray, low: np.ndarray, most: int) -> list[np.ndarray]:
    """Open three-bar gaps, gap made on the bar (1 rising, -1 falling, 0), gaps filled on it, open rising and open falling ones.

    A gap lies between the extremes of this bar and the one two before; a later bar that trades back to its near edge fills
    it. The newest `most` open gaps are kept.
    """
    held: list[tuple[int, float]] = []  # side and near edge
    out = _lines(len(high), 5)
    for k in range(len(high)):
        left = [(s, edge) for s, edge in held if (low[k] > edge if s > 0 else high[k] < edge)]
        filled, made = len(held) - len(left), 0
        if k >= 2 and low[k] > high[k - 2]:
            made = 1
            left.append((1, low[k]))
        elif k >= 2 and high[k] < low[k - 2]:
            made = -1
            left.append((-1, high[k]))
        held = left[-most:]
        rising = sum(s > 0 for s, _ in held)
        for line, v in zip(out, (len(held), made, filled, rising, len(held) - rising), strict=True):
            line[k] = v
    return out


def threshold_turns(close: np.ndarray, high: np.ndarray, low: np.ndarray, distance: np.ndarray) -> list[np.ndarray]:
    """Direction of the leg (0 before any turn), and on bars that confirm a turn its price and its age in bars.

    The running extreme of the leg is a turn once a later close is `distance` of that bar away from it; bars without a
    distance only extend it. Until the first turn both extremes run and the high goes first. The next leg starts from the
    farthest bar after the turn: the earliest of equal lows, the latest of equal highs.
    """
    out = _lines(len(close), 3)
    prices, at, run = {1: high, -1: low}, {1: 0, -1: 0}, 0
    for k, c in enumerate(close):
        sides = [s for s in (1, -1) if run in (0, s)]
        for s in sides:
            if (prices[s][k] - prices[s][at[s]]) * s > 0:
                at[s] = k
        for s in sides if not math.isnan(distance[k]) else []:
            turn = prices[s][at[s]]
            if at[s] < k and (c - (turn - s * distance[k])) * s <= 0:
                out[1][k], out[2][k] = turn, k - at[s]
                after = prices[-s][at[s] + 1 : k + 1]
                at[-s] = at[s] + 1 + int(np.argmin(after)) if s > 0 else k - int(np.argmax(after[::-1]))
                run = -s
                break
        out[0][k] = run
    return out


def rejected_zones(high: np.ndarray, low: np.ndarray, close: np.ndarray, high_pivot: np.ndarray, low_pivot: np.ndarray, atr: np.ndarray, tolerance: float, width: float, touches: int, most: int) -> list[np.ndarray]:
    """Event (1 a failed break below, -1 above), its wick and strength, and the number of zones with enough touches.

    Zones come from pivots: one within `tolerance` mean ranges of a zone of its kind joins the oldest such zone that stays
    within `width` of them. A bar that pierces a zone and closes back inside is rejected by it; if zones of both kinds reject
    it, none counts. A close a fifth of the range beyond a zone ends it, as does a newer one when `most` are held. `atr` is
    the value before the bar.
    """
    out = _lines(len(close), 4)
    zones: list[list] = []  # [kind, bottom, top, touches], 1 support, -1 resistance
    for k in range(len(close)):
        event, wick, force = 0.0, NAN, 0.0
        if not math.isnan(atr[k]):
            hits = {s: max((z[3] for z in zones if z[0] == s and z[3] >= touches and ((low[k] < z[1] < close[k]) if s == 1 else (high[k] > z[2] > close[k]))), default=0) for s in (1, -1)}
            if bool(hits[1]) != bool(hits[-1]):
                event = 1.0 if hits[1] else -1.0
                wick, force = (low if hits[1] else high)[k], min(max(hits.values()) / 5, 1.0)
            zones = [z for z in zones if (close[k] >= z[1] - 0.2 * atr[k] if z[0] == 1 else close[k] <= z[2] + 0.2 * atr[k])]
            for s, p in ((-1, high_pivot[k]), (1, low_pivot[k])):
                if math.isnan(p):
                    continue
                for z in zones:
                    if z[0] == s and z[1] - tolerance * atr[k] <= p <= z[2] + tolerance * atr[k] and max(z[2], p) - min(z[1], p) <= width * atr[k]:
                        z[1], z[2], z[3] = min(z[1], p), max(z[2], p), z[3] + 1
                        break
                else:
                    zones = [*zones[1:], [s, p, p, 1]] if len(zones) == most else [*zones, [s, p, p, 1]]
        out[0][k], out[1][k], out[2][k], out[3][k] = event, wick, force, sum(z[3] >= touches for z in zones)
    return out


def box_columns(high: np.ndarray, low: np.ndarray, box: float, reversal: int) -> list[np.ndarray]:
    """Number, direction (1 up, -1 down), top, bottom and boxes of the present column, whether the bar changed it, opened it.

    Highs count down and lows up to the next line of the grid. A bar first extends the column in its direction; else it opens
    one the other way if it reaches `reversal` boxes back from the end. Before the first column the first bar's boxes widen
    until a bar leaves them on one side only.
    """
    out = _lines(len(high), 7)
    side = column = top = bottom = 0
    held = None
    for k in range(len(high)):
        changed = opened = 0
        if math.isfinite(high[k]) and math.isfinite(low[k]):
            up, down = math.floor(high[k] / box + 1e-9), math.ceil(low[k] / box - 1e-9)
            if not side:
                above, below = held is not None and up > held[0], held is not None and down < held[1]
                if above != below:
                    side, changed, opened, column = (1 if above else -1), 1, 1, 1
                    top, bottom = (up, held[0]) if above else (held[1], down)
                else:
                    held = (up, down) if held is None else (max(up, held[0]), min(down, held[1]))
            elif (up > top) if side == 1 else (down < bottom):
                changed, top, bottom = 1, (up if side == 1 else top), (bottom if side == 1 else down)
            elif (down <= top - reversal) if side == 1 else (up >= bottom + reversal):
                top, bottom = (top - 1, down) if side == 1 else (up, bottom + 1)
                side, changed, opened, column = -side, 1, 1, column + 1
        out[0][k], out[1][k], out[5][k], out[6][k] = column, side, changed, opened
        if side:
            out[2][k], out[3][k], out[4][k] = top * box, bottom * box, top - bottom + 1
    return out


KERNELS = {f.__name__: f for f in (zigzag_legs, pivot_score, structure_breaks, level_sweeps, band_trail, stop_side, smoothed_place, weighted_mean, half_trend, countdown, filtered_stops, open_gaps, threshold_turns, rejected_zones, box_columns)}
