"""Swing nodes, ratio patterns and their fates against plain loops over bars."""

import datetime
import random

import pytest

START = datetime.datetime(2024, 1, 1)
SCHEMA = "series string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def walk(seed, n, step=0.02, digits=1):
    r, price, out = random.Random(seed), 100.0, []
    for k in range(n):
        before, price = price, max(5.0, price * (1 + r.gauss(0, step)))
        high, low = max(before, price) * (1 + abs(r.gauss(0, step / 4))), min(before, price) * (1 - abs(r.gauss(0, step / 4)))
        out.append((START + datetime.timedelta(hours=k), round(before, digits), round(high, digits), round(low, digits), round(price, digits)))
    return out


def bars_frame(spark, series):
    rows = [(name, ts, o, max(o, h, c), min(o, low, c), c, 1.0) for name, bars in series.items() for ts, o, h, low, c in bars]
    return spark.createDataFrame(rows, SCHEMA)


def plain_nodes(bars, depth=3, backstep=2, share=0.01):
    """(side, price, at, found_at), numbers from 1, by one pass over the bars."""
    nodes, run, turned = [], None, None
    for now in range(2 * depth, len(bars)):
        m = now - depth
        around = bars[m - depth : now + 1]
        kinds = [s for s, top in ((1, bars[m][2] == max(b[2] for b in around)), (-1, bars[m][3] == min(b[3] for b in around))) if top]
        price = {1: bars[m][2], -1: bars[m][3]}
        ready = turned is None or m - turned >= backstep
        if run is None:
            if len(kinds) == 1:
                run = (kinds[0], price[kinds[0]], m)
            continue
        for kind in sorted(kinds, key=lambda k: k != run[0]):
            if kind == run[0]:
                if (price[kind] - run[1]) * kind > 0:
                    run = (kind, price[kind], m)
            elif ready and (price[kind] - run[1]) * kind > 0 and (price[kind] - run[1]) * kind / abs(run[1]) >= share:
                nodes.append((run[0], run[1], run[2] + 1, now + 1))
                run, turned = (kind, price[kind], m), m
    return nodes


def plain_patterns(bars, nodes, table, complete, tolerance=0.03, least=0.005, pending=2):
    """(pattern, last_at, bullish, zone, state, decided bar) by a walk over each structure's later bars."""
    out, width = [], 5 if complete else 4
    for k in range(width - 1, len(nodes)):
        points = nodes[k - width + 1 : k + 1]
        x, a, b, c = (p[1] for p in points[:4])
        if x == a or a == b or b == c:
            continue
        shares = [abs(b - a) / abs(a - x), abs(c - b) / abs(b - a)]
        if complete:
            d = points[4][1]
            shares += [abs(d - a) / abs(a - x), abs(d - c) / abs(c - b)]
        for name, *limits in table:
            if not all(lo - tolerance <= s <= hi + tolerance for s, lo, hi in zip(shares, limits[::2], limits[1::2])):
                continue
            ends = [a - (limits[4] + limits[5]) / 2 * (a - x), c - (limits[6] + limits[7]) / 2 * (c - b), c + b - a]
            low, high, floor = min(ends), max(ends), least * abs(a - x)
            if high - low < floor:
                low, high = (high + low) / 2 - floor / 2, (high + low) / 2 + floor / 2
            bullish, last, found = points[0][0] < 0, points[-1][2], points[-1][3]
            stop = nodes[k + pending + 1][3] if k + pending + 1 < len(nodes) else None
            state, decided = ("complete" if complete else "candidate"), None
            for n, (_, _, hi, lo, close) in enumerate(bars[last : stop or len(bars)], last + 1):
                was = state
                if state == "candidate" and (lo <= high if bullish else hi >= low):
                    state = "complete"
                if state == "complete" and (close < low if bullish else close > high):
                    state = "invalidated"
                elif was == "complete" and (close > high if bullish else close < low):
                    state = "confirmed"
                if state in ("invalidated", "confirmed"):
                    decided = max(n, found)
                    break
            if decided is None and stop:
                state = "dropped"
            out.append((name, last, bullish, round(low, 9), round(high, 9), state, decided))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def series():
    return {f"s{k}": walk(k, 900) for k in range(6)} | {"flat": [(START + datetime.timedelta(hours=k), 9.0, 9.0, 9.0, 9.0) for k in range(40)], "short": walk(1, 5)}


def test_swing_nodes(spark, series):
    from tidemark.plans.patterns import swing_nodes

    got = {}
    for r in swing_nodes(bars_frame(spark, series)).collect():
        got.setdefault(r.series, []).append((r.nth, r.side, r.price, r.at, r.found_at))
    assert set(got) == {f"s{k}" for k in range(6)}
    for name, rows in got.items():
        assert [x[1:] for x in sorted(rows)] == plain_nodes(series[name])


def test_nodes_by_mean_range(spark, series):
    from tidemark.plans.patterns import swing_nodes
    from pyspark.sql import functions as F

    bars = bars_frame(spark, {"s0": series["s0"]})
    by_share = swing_nodes(bars, deviation=2.0).drop("series").collect()
    move = bars.withColumn("range", F.lit(2.0))
    wide = swing_nodes(move, deviation=1.0, atr="range").collect()
    assert all(abs(a.price - b.price) >= 2.0 for a, b in zip(wide, wide[1:])) and wide and by_share
    assert swing_nodes(bars.withColumn("range", F.lit(None).cast("double")), deviation=1.0, atr="range").count() == 0


@pytest.mark.parametrize("complete", [True, False])
def test_harmonic_patterns(spark, series, complete):
    from tidemark.plans import patterns

    found = patterns.harmonic_patterns(bars_frame(spark, series), complete=complete).collect()
    states = set()
    for name, bars in series.items():
        want = plain_patterns(bars, plain_nodes(bars), patterns.HARMONIC_RATIOS, complete)
        place = {b[0]: n for n, b in enumerate(bars, 1)}
        got = [(r.pattern, r.last_at, r.bullish, round(r.zone_low, 9), round(r.zone_high, 9), r.state, place.get(r.decided_ts)) for r in found if r.series == name]
        assert sorted(got, key=str) == want
        states |= {w[5] for w in want}
    assert {"confirmed", "invalidated"} <= states and ("dropped" in states or complete)


def test_a_pattern_by_hand(spark):
    """X 100, A 120, B 107.64, C 113.82, D 104.28: B gives back 0.618 of XA, C half of AB, D 0.786 of XA."""
    from pyspark.sql import functions as F
    from tidemark.plans import patterns

    points = [(-1, 100.0), (1, 120.0), (-1, 107.64), (1, 113.82), (-1, 104.28)]
    rows = [("a", n, side, price, 10 * n, START + datetime.timedelta(hours=10 * n), 10 * n + 3, START + datetime.timedelta(hours=10 * n + 3)) for n, (side, price) in enumerate(points, 1)]
    nodes = spark.createDataFrame(rows, patterns._NODES)
    found = patterns.harmonic_structures(nodes).collect()
    assert [r.pattern for r in found] == ["gartley"] and found[0].bullish and found[0].zone_low < 104.28 < found[0].zone_high
    assert abs(found[0].b_share - 0.618) < 1e-9 and abs(found[0].c_share - 0.5) < 1e-9 and abs(found[0].d_share - 0.786) < 1e-9
    off = nodes.withColumn("price", F.when(F.col("nth") == 3, 112.0).otherwise(F.col("price")))
    assert patterns.harmonic_structures(off).count() == 0 and patterns.harmonic_structures(nodes.limit(0)).count() == 0
