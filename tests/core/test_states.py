"""Swing and trailing operators against bar-by-bar versions that read each bar's whole history."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from tidemark import catalog
from tidemark.operators.spec import apply, build

N = 300


@pytest.fixture(scope="module")
def walk(spark):
    r = np.random.default_rng(5)
    close = np.round(100 * np.exp(np.cumsum(r.normal(0, 0.02, N))), 1)  # rounded: ties occur
    high, low = np.round(close * (1 + abs(r.normal(0, 0.01, N))), 1), np.round(close * (1 - abs(r.normal(0, 0.01, N))), 1)
    frame = pd.DataFrame({"series": "a", "ts": [datetime(2024, 1, 1) + timedelta(hours=k) for k in range(N)], "open": close, "high": np.maximum(high, close), "low": np.minimum(low, close), "close": close, "volume": r.integers(1, 99, N).astype(float)})
    rows = [("a", x.ts.to_pydatetime(), *(float(v) for v in (x.open, x.high, x.low, x.close, x.volume))) for x in frame.itertuples(index=False)]
    return frame, spark.createDataFrame(rows, "series string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def run(df, name, **params):
    return apply(df, [build(name, **params)]).orderBy("ts").toPandas()


def pivots(f, k, left, right, strict):
    """High and low pivot confirmed on bar k, by looking at every bar around the candidate."""
    at = k - right
    if at < left:
        return None, None
    others = [j for j in range(at - left, k + 1) if j != at]
    beats = (lambda a, b: a > b) if strict else (lambda a, b: a >= b)
    top = all(beats(f.high[at], f.high[j]) for j in others)
    bottom = all(beats(-f.low[at], -f.low[j]) for j in others)
    return f.high[at] if top else None, f.low[at] if bottom else None


def same(got, want):
    got, want = np.array(got, float), np.array([math.nan if v is None else v for v in want], float)
    assert np.allclose(got, want, equal_nan=True), np.flatnonzero(~np.isclose(got, want, equal_nan=True))[:5]


def test_zigzag(walk):
    f, df = walk
    nodes, values, sides = [], [], []
    for k in range(N):
        h, low = pivots(f, k, 4, 4, False)
        todo = []
        if h is not None and low is not None:
            if nodes:
                todo = [("H", h), ("L", low)] if nodes[-1][0] == "H" else [("L", low), ("H", h)]
        elif h is not None:
            todo = [("H", h)]
        elif low is not None:
            todo = [("L", low)]
        for kind, p in todo:
            if not nodes:
                nodes.append((kind, p))
            elif nodes[-1][0] == kind:
                if (kind == "H" and p > nodes[-1][1]) or (kind == "L" and p < nodes[-1][1]):
                    nodes[-1] = (kind, p)
            else:
                gain = p - nodes[-1][1] if kind == "H" else nodes[-1][1] - p
                if gain > 0 and 100 * gain / nodes[-1][1] >= 3.0:
                    nodes.append((kind, p))
        ready = k >= 8
        values.append((nodes[-1][1] if nodes else 0.0) if ready else None)
        sides.append(({"H": 1, "L": -1}[nodes[-1][0]] if nodes else 0) if ready else None)
    got = run(df, "zigzag", depth=4, deviation_pct=3.0)
    same(got.value, values), same(got.direction, sides)
    assert len(nodes) > 6


@pytest.mark.parametrize("name, strict", [("bos_choch", False), ("market_structure_breaks", True)])
def test_breaks(walk, name, strict):
    f, df = walk
    high = low = None
    trend, events, trends = "none", [], []
    for k in range(N):
        h, b = pivots(f, k, 5, 5, strict)
        high, low = h if h is not None else high, b if b is not None else low
        event = 0
        if high is not None and f.close[k] > high:
            event, trend, high = (1 if trend == "up" else 2), "up", None
        if low is not None and f.close[k] < low:
            event, trend, low = (-1 if trend == "down" else -2), "down", None
        events.append(event if k >= 10 else None), trends.append({"none": 0, "up": 1, "down": -1}[trend] if k >= 10 else None)
    got = run(df, name)
    same(got.value, events), same(got.trend, trends)
    assert {1, 2, -1, -2} & set(events)


def test_pivot_score_and_sweeps(walk):
    f, df = walk
    highs, lows, scores, want = [], [], [], []
    levels_h, levels_l, swept = [], [], []
    for k in range(N):
        h, b = pivots(f, k, 3, 3, True)
        s = []
        if h is not None:
            s += [2 if h > highs[-1] else -1] if highs else []
            highs.append(h)
        if b is not None:
            s += [1 if b > lows[-1] else -2] if lows else []
            lows.append(b)
        scores += [sum(s)] if s else []
        want.append(max(-100, min(100, 100 * sum(scores[-10:]) / 20)) if k >= 6 else None)
        h, b = pivots(f, k, 3, 3, False)
        levels_h, levels_l = (levels_h + ([h] if h is not None else []))[-20:], (levels_l + ([b] if b is not None else []))[-20:]
        hit = -1 if any(f.high[k] > x and f.close[k] < x for x in levels_h) else 1 if any(f.low[k] < x and f.close[k] > x for x in levels_l) else 0
        levels_h, levels_l = [x for x in levels_h if not f.high[k] > x], [x for x in levels_l if not f.low[k] < x]
        swept.append(hit if k >= 6 else None)
    same(run(df, "pivots_structure", left_bars=3, right_bars=3).value, want)
    got = run(df, "liquidity_sweeps", pivot_len=3, tolerance_pct=0.2)
    same(got.value, swept)
    assert got.eqh_count.iloc[-1] == sum(abs(a - b) / a * 100 <= 0.2 for a, b in zip(levels_h, levels_h[1:]))


def test_setup_and_countdown(walk):
    f, df = walk
    c, kind, n, values = f.close, None, 0, []
    for k in range(N):
        if k < 5:
            values.append(None)
            continue
        now, before = np.sign(c[k] - c[k - 4]), np.sign(c[k - 1] - c[k - 5])
        if now and kind == now:
            n += 1
        elif now and before == -now:
            kind, n = now, 1
        else:
            kind, n = None, 0
        values.append((kind or 0) * n)
    got = run(df, "setup_countdown")
    same(got.value, values)
    assert got.countdown.abs().max() >= 8 and (got.countdown.abs() <= 13).all() or got.countdown.isna().sum() == 5


def wilder(x, n):
    out = [None] * len(x)
    for k in range(n - 1, len(x)):
        out[k] = sum(x[:n]) / n if k == n - 1 else out[k - 1] + (x[k] - out[k - 1]) / n
    return out


def exponential(x, n):
    out = []
    for v in x:
        out.append(v if not out else out[-1] + 2 / (n + 1) * (v - out[-1]))
    return out


def test_schaff(walk):
    f, df = walk
    macd = np.array(exponential(f.close, 23)) - np.array(exponential(f.close, 50))
    def stage(x, first):
        out, value = [None] * N, None
        for k in range(first, N):
            part = [v for v in x[k - 9 : k + 1]]
            place = 100 * (x[k] - min(part)) / (max(part) - min(part))
            value = place if value is None else value + 0.5 * (place - value)
            out[k] = value
        return out
    want = stage(stage(macd, 9), 18)
    same(run(df, "schaff_trend_cycle").value, [v if k >= 49 else None for k, v in enumerate(want)])


def test_chandelier_and_qqe(walk):
    f, df = walk
    tr = [max(f.high[k], f.close[k - 1]) - min(f.low[k], f.close[k - 1]) if k else f.high[0] - f.low[0] for k in range(N)]
    atr = wilder(tr, 22)
    a = b = None
    side, stops, sides = 1, [], []
    for k in range(N):
        if k < 21:
            stops.append(None), sides.append(None)
            continue
        raw_a, raw_b = max(f.high[k - 21 : k + 1]) - 3 * atr[k], min(f.low[k - 21 : k + 1]) + 3 * atr[k]
        pa, pb = (raw_a, raw_b) if a is None else (a, b)
        a = max(raw_a, pa) if f.close[k - 1] > pa else raw_a
        b = min(raw_b, pb) if f.close[k - 1] < pb else raw_b
        up, down = f.close[k] > pb, f.close[k] < pa
        side = side if up == down else 1 if up else -1
        stops.append(a if side > 0 else b), sides.append(side)
    got = run(df, "chandelier_exit")
    same(got.value, stops), same(got.direction, sides)
    assert {1, -1} <= set(sides)

    moves = np.diff(f.close)
    up, down = wilder(np.maximum(moves, 0), 14), wilder(np.maximum(-moves, 0), 14)
    rsi = [100 * u / (u + d) if u + d else 50.0 for u, d in zip(up[13:], down[13:])]
    m = exponential(rsi, 5)
    width = 4.236 * np.array(exponential(exponential(np.abs(np.diff(m)), 27), 27))
    trend, trail, low, high = 0, [], None, None
    for k in range(1, len(m)):
        raw = m[k] - width[k - 1], m[k] + width[k - 1]
        if low is None:
            low, high = raw
        else:
            trend = 1 if m[k] > high else -1 if m[k] < low else trend
            low = max(low, raw[0]) if m[k - 1] > low and m[k] > low else raw[0]
            high = min(high, raw[1]) if m[k - 1] < high and m[k] < high else raw[1]
        trail.append({0: m[k], 1: low, -1: high}[trend])
    got = run(df, "qqe")
    same(got.trail, [None] * 15 + trail), same(got.value, [None] * 15 + m[1:])


def test_ott_and_halftrend(walk):
    f, df = walk
    var, stop, side, lines = None, None, 0, []
    under = over = None
    for k in range(N):
        steps = [f.close[j] - f.close[j - 1] if j else 0.0 for j in range(max(0, k - 8), k + 1)]
        total = sum(abs(x) for x in steps)
        weight = 2 / 3 * abs(sum(steps)) / total if total else 0.0
        var = f.close[0] if k == 0 else weight * f.close[k] + (1 - weight) * var
        raw = var * (1 - 0.014), var * (1 + 0.014)
        if under is None:
            under, over = raw
        else:
            side = 1 if side != 1 and var > over else -1 if side != -1 and var < under else side
            under, over = (max(under, raw[0]) if var > under else raw[0]), (min(over, raw[1]) if var < over else raw[1])
        stop = {0: None, 1: under, -1: over}[side]
        lines.append(None if stop is None or k < 9 else stop * (1.007 if var > stop else 0.993))
    same(run(df, "ott").value, lines)

    trend, line, best_low, best_high, want = 0, None, None, None, []
    for k in range(N):
        if k:
            hs, ls = f.high[k - 1 : k + 1], f.low[k - 1 : k + 1]
            if best_low is None:
                best_low, best_high = f.low[k - 1], f.high[k - 1]
            was = trend
            if was != -1:
                best_low = max(best_low, min(ls))
            if was != 1:
                best_high = min(best_high, max(hs))
            if was != -1 and hs.mean() < best_low and f.close[k] < f.low[k - 1]:
                trend, best_high = -1, max(hs)
            elif was != 1 and ls.mean() > best_high and f.close[k] > f.high[k - 1]:
                trend, best_low = 1, min(ls)
            if trend == 1:
                line = best_low if was == 0 else line if was == -1 else max(line, best_low)
            if trend == -1:
                line = best_high if was == 0 else line if was == 1 else min(line, best_high)
        want.append(line if k >= 99 else None)
    same(run(df, "halftrend").value, want)


def test_adaptive_chandelier_and_gap_fills(walk):
    f, df = walk
    tr = [max(f.high[k], f.close[k - 1]) - min(f.low[k], f.close[k - 1]) if k else f.high[0] - f.low[0] for k in range(N)]
    atr, mean = wilder(tr, 30), exponential(f.close, 5)
    side, stops, value, risk = 1, None, [], []
    for k in range(N):
        if k < 29:
            value.append(None), risk.append(None)
            continue
        last = f.close[k - 29 : k + 1]
        raw = {1: max(last) - 1.5 * atr[k], -1: min(last) + 1.5 * atr[k]}
        before = stops or raw
        stops = {1: max(raw[1], before[1]) if side == 1 else raw[1], -1: min(raw[-1], before[-1]) if side == -1 else raw[-1]}
        if (f.close[k] > before[-1]) ^ (f.close[k] < before[1]):
            side = 1 if f.close[k] > before[-1] else -1
        away = abs(f.close[k] - before[side]) / atr[k]
        wrong = f.close[k] < mean[k] if side == 1 else f.close[k] > mean[k]
        value.append(stops[side]), risk.append(side * (1 if away < 0.35 else 2 if away < 0.75 or wrong else 3))
    got = run(df, "adaptive_chandelier", atr_mult=1.5, body_filter_atr=0.0)
    same(got.value, value), same(got.risk_state, risk)
    assert {-1, 1} <= set(np.sign([r for r in risk if r]))

    zones, opened, filled = [], [], []
    for k in range(N):
        hit = [z for z in zones if (f.low[k] <= z[1] if z[0] == "up" else f.high[k] >= z[1])]
        zones = [z for z in zones if z not in hit]
        if k >= 2 and f.low[k] > f.high[k - 2]:
            zones.append(("up", f.low[k], k))
        if k >= 2 and f.high[k] < f.low[k - 2]:
            zones.append(("down", f.high[k], k))
        zones = zones[-4:]
        opened.append(len(zones)), filled.append(len(hit))
    got = run(df, "fvg_fill", max_zones=4)
    same(got.value, opened), same(got.filled, filled)
    assert sum(filled) > 10 and max(opened) == 4


def test_first_outputs_and_known_values(spark, walk):
    _, df = walk
    first = {"vix_fix": 39, "alligator": 13, "true_range_money_flow": 22, "klinger": 55, "qqe": 16, "chandelier_exit": 22}
    for name, bar in first.items():
        got = run(df, name)
        assert got.value.first_valid_index() == bar - 1, name
    lines = run(df, "alligator")
    assert lines[["jaw", "teeth", "lips"]].notna().all(axis=1).idxmax() == 12 and lines.jaw[12] == lines.jaw[20]
    flow = catalog.QUERIES["klinger"](spark, "/root/testdata/sf0.01").filter("series = 'click'").orderBy("ts").toPandas()
    assert np.allclose(flow.value[200:204], [0.87, 5.38, 2.79, 9.00], atol=0.005)


def test_a_bundle_needs_few_exchanges(spark):
    plan = catalog.QUERIES["trend_bundle"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and plan.count("FlatMapGroupsInPandas [") <= 2


def turns_by_rescan(f, distance):
    """Turns as (bar of the turn, side, confirming bar), each bar's running extreme found anew from the last turn."""
    found = []

    def running(k, side):
        x = f.high if side > 0 else -f.low
        if not found:
            return max(range(k + 1), key=lambda j: (x[j], -j))
        turn, _, confirmed = found[-1]
        start = max(range(turn + 1, confirmed + 1), key=lambda j: (x[j], j * side))
        later = [j for j in range(confirmed + 1, k + 1) if x[j] > x[start]]
        return max(later, key=lambda j: (x[j], -j)) if later else start

    for k in range(len(f)):
        if math.isnan(distance[k]):
            continue
        for side in [1, -1] if not found else [-found[-1][1]]:
            j = running(k, side)
            price = f.high[j] if side > 0 else f.low[j]
            if j < k and (f.close[k] <= price - distance[k] if side > 0 else f.close[k] >= price + distance[k]):
                found.append((j, side, k))
                break
    return found


def test_threshold_zigzag(walk):
    f, df = walk
    before = f.close.shift()
    tr = np.fmax(f.high - f.low, np.fmax(abs(f.high - before), abs(f.low - before)))
    want = turns_by_rescan(f, (2.0 * tr.rolling(5).mean()).to_numpy())
    got = run(df, "threshold_zigzag", length=5, multiple=2.0)
    shown = [(k - int(got.age[k]), got["pivot"][k], k) for k in range(N) if not np.isnan(got["pivot"][k])]
    assert len(want) > 10 and [w[2] for w in want] == [s[2] for s in shown] and [w[0] for w in want] == [s[0] for s in shown]
    assert all(p == (f.high[j] if side > 0 else f.low[j]) for (_, p, _), (j, side, _) in zip(shown, want, strict=True))
    assert got.direction[want[0][2] - 1] == 0 and all(got.direction[k] == -side for _, side, k in want)
