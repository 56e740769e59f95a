"""Chart shapes by plain geometry over lists of nodes, their outcomes by a walk over bars, and shapes drawn by hand."""

import datetime

import pytest

from test_patterns import START, bars_frame, plain_nodes, walk


def through(a, b):
    return lambda t: a[0] + (b[0] - a[0]) / (b[1] - a[1]) * (t - a[1])


def level(price):
    return lambda t: price


def plain_shapes(ends, tol=0.02, flat=0.015):
    """(kind, nodes, fit, bias, up, down, goal) of the shapes that end on the last of `ends`, (price, time, side) each."""
    out = []
    same = lambda a, b, s: abs(a - b) <= tol * abs(s)
    near = lambda a, b, s: max(0.0, 1 - abs(a - b) / (tol * abs(s)))
    if len(ends) >= 3:
        a, b, c = ends[-3:]
        if c[2] * (c[0] - a[0]) > 0:
            lines = (level(c[0]), level(b[0])) if c[2] > 0 else (level(b[0]), level(c[0]))
            out.append(("reversal_123", 3, min(1, abs(c[0] - a[0]) / a[0]), c[2], *lines, None))
        if same(a[0], c[0], a[0]) and not same(a[0], b[0], a[0]):
            if c[2] > 0:
                out.append(("double_top", 3, near(a[0], c[0], a[0]), -1, level(max(a[0], c[0])), level(b[0]), None))
            else:
                out.append(("double_bottom", 3, near(a[0], c[0], a[0]), 1, level(b[0]), level(min(a[0], c[0])), None))
    if len(ends) >= 4:
        a, b, c, d = ends[-4:]
        hi, lo = (through(b, d), through(a, c)) if d[2] > 0 else (through(a, c), through(b, d))
        g0, g1 = hi(a[1]) - lo(a[1]), hi(d[1]) - lo(d[1])
        if g0 > 0 and g1 > 0 and g0 != g1:
            up, low = hi(d[1]) - hi(a[1]), lo(d[1]) - lo(a[1])
            upflat, lowflat = abs(up) / g0 < flat, abs(low) / g0 < flat
            kind = None
            if g1 > g0:
                if up > 0 > low and not upflat and not lowflat:
                    kind = "broadening"
            elif up > 0 and low > 0:
                kind = "rising_wedge"
            elif up < 0 and low < 0:
                kind = "falling_wedge"
            elif upflat and low > 0:
                kind = "ascending_triangle"
            elif lowflat and up < 0:
                kind = "descending_triangle"
            elif up <= 0 <= low:
                kind = "triangle"
            if kind:
                out.append((kind, 4, 1 - min(g0, g1) / max(g0, g1), 0, hi, lo, None))
        if same(a[0], c[0], a[0]) and not same(a[0], b[0], a[0]) and 2 * (d[1] - c[1]) <= c[1] - a[1]:
            half = (c[0] + b[0]) / 2
            if a[2] > 0 and d[0] >= half:
                out.append(("cup_and_handle", 4, near(a[0], c[0], a[0]), 1, level(c[0]), level(d[0]), None))
            if a[2] < 0 and d[0] <= half:
                out.append(("inverse_cup_and_handle", 4, near(a[0], c[0], a[0]), -1, level(d[0]), level(c[0]), None))
    if len(ends) >= 5:
        a, b, c, d, e = ends[-5:]
        prices = [x[0] for x in ends[-5:]]
        high = e[2] > 0
        if same(a[0], c[0], a[0]) and same(a[0], e[0], a[0]) and not same(a[0], b[0], a[0]):
            fit = near(a[0], c[0], a[0]) * near(a[0], e[0], a[0])
            out.append(("triple_top", 5, fit, -1, level(max(prices)), level(min(b[0], d[0])), None) if high else ("triple_bottom", 5, fit, 1, level(max(b[0], d[0])), level(min(prices)), None))
        if (c[0] > max(a[0], e[0]) if high else c[0] < min(a[0], e[0])) and same(a[0], e[0], c[0]) and same(b[0], d[0], c[0]):
            fit = near(a[0], e[0], c[0]) * near(b[0], d[0], c[0])
            out.append(("head_and_shoulders", 5, fit, -1, level(max(prices)), through(b, d), None) if high else ("inverse_head_and_shoulders", 5, fit, 1, through(b, d), level(min(prices)), None))
        one, two = through(a, c), through(b, d)
        if high:
            waves = c[0] > a[0] and b[0] < d[0] < a[0] and two(1e6) - two(0) > one(1e6) - one(0) and e[0] > one(e[1])
        else:
            waves = c[0] < a[0] and a[0] < d[0] < b[0] and two(1e6) - two(0) < one(1e6) - one(0) and e[0] < one(e[1])
        if waves:
            gap = lambda t: abs(two(t) - one(t)) if (two(t) > one(t)) != high else -abs(two(t) - one(t))
            out.append(("wolfe_wave", 5, min(1.0, max(0.0, 1 - gap(e[1]) / max(gap(a[1]), 1e-9))), -1 if high else 1, level(e[0]), level(e[0]), through(a, d)))
        far = through(c, e)
        if (d[0] > b[0] and e[0] > c[0]) if high else (d[0] < b[0] and e[0] < c[0]):
            gap = lambda t: far(t) - two(t) if high else two(t) - far(t)
            g0, g1 = gap(b[1]), gap(e[1])
            deep = abs(b[0] - (max(c[0], e[0]) if high else min(c[0], e[0])))
            if g0 > 0 and g1 > 0 and abs(g1 - g0) / g0 <= 0.25 and deep <= 0.5 * abs(b[0] - a[0]):
                fit = 1 - abs(g1 - g0) / g0 / 0.25
                out.append(("flag", 5, fit, -1, far, two, None) if high else ("flag", 5, fit, 1, two, far, None))
    return out


def plain_outcome(shape, bars, first, stop):
    """(state, bullish, bar number) of the first deciding bar from number `first` to `stop`."""
    _, _, _, bias, up, down, goal = shape
    for n in range(first, (stop or len(bars)) + 1):
        t, close = seconds(bars[n - 1][0]), bars[n - 1][4]
        if bias >= 0 and close > up(t) and (goal is None or close <= goal(t)):
            return "confirmed", True, n
        if bias <= 0 and close < down(t) and (goal is None or close >= goal(t)):
            return "confirmed", False, n
        if (bias > 0 and close < down(t)) or (bias < 0 and close > up(t)):
            return "invalidated", bias > 0, n
    return ("dropped" if stop else "forming"), (bias > 0 if bias else None), None


def seconds(ts):
    return (ts - datetime.datetime(1970, 1, 1)).total_seconds()


def plain_chart(bars, pending=2):
    nodes = plain_nodes(bars)
    ends = [(price, seconds(bars[at - 1][0]), side) for side, price, at, _ in nodes]
    out = []
    for k in range(len(nodes)):
        stop = nodes[k + pending + 1][3] if k + pending + 1 < len(nodes) else None
        for shape in plain_shapes(ends[: k + 1]):
            state, bullish, n = plain_outcome(shape, bars, nodes[k][2] + 1, stop)
            decided = bars[max(n, nodes[k][3]) - 1][0] if n else None
            out.append((shape[0], k + 2 - shape[1], k + 1, round(shape[2], 6), state, bullish, decided))
    return out


def plain_apart(rows):
    kept = []
    for row in sorted(rows, key=lambda r: (-r[3], r[2])):
        if all(row[0] != k[0] or row[1] > k[2] or k[1] > row[2] for k in kept):
            kept.append(row)
    return kept


@pytest.fixture(scope="module")
def series():
    made = {f"s{k}": walk(40 + k, 500, 0.006 + 0.003 * k, 2) for k in range(8)}
    made["short"] = walk(1, 5)
    return made


def told(rows):
    return sorted(((r.kind, r.first_nth, r.last_nth, round(r.fit, 6), r.state, r.bullish, r.decided_ts) for r in rows), key=str)


def test_shapes_and_outcomes(spark, series):
    from tidemark.plans.shapes import chart_patterns

    found = chart_patterns(bars_frame(spark, series)).collect()
    kinds, states = set(), set()
    for name, bars in series.items():
        want = plain_chart(bars)
        assert told(r for r in found if r.series == name) == sorted(want, key=str), name
        kinds |= {w[0] for w in want}
        states |= {w[4] for w in want}
    assert states >= {"confirmed", "invalidated", "dropped"} and len(kinds) >= 14, kinds
    assert all((r.level is not None) == (r.state == "confirmed") and 0 <= r.fit <= 1 for r in found)


def test_best_apart(spark, series):
    from tidemark.plans.shapes import chart_patterns

    found = chart_patterns(bars_frame(spark, series), apart=True).collect()
    for name, bars in series.items():
        everything = plain_chart(bars)
        want = plain_apart(everything)
        assert told(r for r in found if r.series == name) == sorted(want, key=str), name
        assert len(want) < len(everything) or not everything


DRAWN = {
    "head_and_shoulders": [(1, 110), (-1, 104), (1, 120), (-1, 104.5), (1, 110.5)],
    "inverse_head_and_shoulders": [(-1, 90), (1, 96), (-1, 80), (1, 95.5), (-1, 89.5)],
    "triple_top": [(1, 110), (-1, 100), (1, 110.4), (-1, 101), (1, 109.8)],
    "triple_bottom": [(-1, 90), (1, 100), (-1, 90.3), (1, 99), (-1, 89.9)],
    "flag": [(-1, 100), (1, 140), (-1, 132), (1, 137), (-1, 129)],
    "wolfe_wave": [(-1, 100), (1, 112), (-1, 96), (1, 104), (-1, 91)],
    "cup_and_handle": [(1, 120), (-1, 100), (1, 120.5), (-1, 114)],
    "inverse_cup_and_handle": [(-1, 100), (1, 120), (-1, 99.5), (1, 105)],
    "ascending_triangle": [(1, 120), (-1, 100), (1, 119.9), (-1, 110)],
    "descending_triangle": [(-1, 100), (1, 120), (-1, 100.1), (1, 110)],
    "broadening": [(1, 110), (-1, 100), (1, 115), (-1, 95)],
    "triangle": [(1, 120), (-1, 100), (1, 115), (-1, 105)],
}


def test_drawn_shapes(spark):
    """Each drawing is found under its name; nodes ten hours apart, the last one three hours after the one before."""
    from tidemark.plans import patterns, shapes

    rows = []
    for name, points in DRAWN.items():
        for n, (side, price) in enumerate(points, 1):
            at = 10 * n - (7 if n == len(points) and "cup" in name else 0)
            rows.append((name, n, side, float(price), at, START + datetime.timedelta(hours=at), at + 3, START + datetime.timedelta(hours=at + 3)))
    nodes = spark.createDataFrame(rows, patterns._NODES)
    found = shapes.chart_shapes(nodes).collect()
    for name in DRAWN:
        assert name in {r.kind for r in found if r.series == name and r.last_nth == len(DRAWN[name])}, name
    assert {r.until for r in found} == {None}  # no drawing has three more nodes
    assert shapes.chart_shapes(nodes.limit(0)).count() == 0 and shapes.best_apart(shapes.chart_shapes(nodes.limit(0))).count() == 0


def test_fitted_lines(spark):
    from tidemark.plans import patterns, shapes

    def nodes(name, prices, side):
        return [(name, n, side, float(p), n, START + datetime.timedelta(hours=n), n, START + datetime.timedelta(hours=n)) for n, p in enumerate(prices, 1)]

    rows = nodes("held", [100, 100.5, 101, 103], 1) + nodes("held", [90, 80, 95], -1) + nodes("pierced", [100, 110, 101], 1) + nodes("one", [100], 1)
    found = {(r.series, r.side): r for r in shapes.fitted_lines(spark.createDataFrame(rows, patterns._NODES)).collect()}
    assert set(found) == {("held", 1)}
    line = found["held", 1]
    assert line.touches == 4 and line.fit == 1.0 and abs(line.slope * 3600 - 1) < 1e-12 and (line.first_price, line.last_price) == (100.0, 103.0)
