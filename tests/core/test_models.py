"""Resampling, models, outcomes and zones against plain step-by-step versions."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans import models, outcomes, resampling, zones

DAY = dt.datetime(2024, 1, 1)
MASK = (1 << 64) - 1


def walk(spark, n, seed, names=("a", "b")):
    draw, rows = random.Random(seed), []
    for name in names:
        close = 100.0
        for k in range(n):
            o, close = close, max(5.0, close + draw.gauss(0, 2))
            rows.append((name, DAY + dt.timedelta(hours=k), o, max(o, close) + draw.random(), min(o, close) - draw.random(), close, float(draw.randint(1, 9))))
    return rows, spark.createDataFrame(rows, "series string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


class Stream:
    def __init__(self, seed):
        self.s = seed

    def uniform(self):
        self.s = (self.s + 0x9E3779B97F4A7C15) & MASK
        z = self.s
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
        return ((z ^ (z >> 31)) >> 11) / 2**53


def plain_snooping(series, mean_block, paths, seed):
    t, draw, root = len(series[0]), Stream(seed), math.sqrt(len(series[0]))
    own = [sum(d) / t for d in series]
    boot = []
    for _ in range(paths):
        at = [min(int(draw.uniform() * t), t - 1)]
        while len(at) < t:
            at.append(min(int(draw.uniform() * t), t - 1) if draw.uniform() < 1 / mean_block else (at[-1] + 1) % t)
        boot.append([sum(d[i] for i in at) / t for d in series])
    omega = [math.sqrt(sum((root * (b[j] - own[j])) ** 2 for b in boot) / paths) for j in range(len(series))]
    live = [j for j in range(len(series)) if omega[j] > 1e-12 * abs(own[j])]
    bar = math.sqrt(2 * math.log(math.log(t)))
    top = max([0.0, *[root * own[j] / omega[j] for j in live]])
    mu = [own[j] if j in live and root * own[j] / omega[j] >= -bar else 0.0 for j in range(len(series))]
    rc = sum(max(root * (b[j] - own[j]) for j in range(len(series))) >= root * max(own) for b in boot)
    spa = sum(max([0.0, *[root * (b[j] - mu[j]) / omega[j] for j in live]]) >= top for b in boot)
    return own.index(max(own)), max(own), rc / paths, spa / paths


@pytest.mark.parametrize(("n", "mean_block", "seed"), [(40, 4.0, 5), (7, 50.0, 6), (30, 1.0, 2**63 + 9)])
def test_data_snooping_equals_a_plain_run(spark, n, mean_block, seed):
    draw = random.Random(n)
    series = [[draw.gauss(m, 1) for _ in range(n)] for m in (0.1, -2.0, 0.3)] + [[0.05] * n]
    rows = [(f"r{j}", k, v) for j, d in enumerate(series) for k, v in enumerate(d)]
    out = resampling.data_snooping(spark.createDataFrame(rows, "rule string, pos long, value double"), mean_block, 150, seed).collect()
    best, mean, rc, spa = plain_snooping(series, mean_block, 150, seed)
    assert [(r.best, r.p_reality_check, r.p_spa) for r in out] == [(f"r{best}", rc, spa)] and abs(out[0].best_mean - mean) < 1e-12


def test_data_snooping_refuses_ragged_rules(spark):
    shape = "rule string, pos long, value double"
    for rows in ([], [("a", 0, 1.0)], [("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 1.0)], [("a", 0, 1.0), ("a", 1, None)]):
        assert resampling.data_snooping(spark.createDataFrame(rows, shape)).collect() == []


def congruence(seed, add):
    x = (seed + 1) & MASK
    while True:
        x = (x * 6364136223846793005 + add) & MASK
        yield x


def test_brier_bootstrap_and_paths_equal_plain_runs(spark):
    draw = random.Random(8)
    rows = [(k, draw.uniform(-0.2, 1.2), draw.random() < 0.4) for k in range(53)]
    out = resampling.brier_bootstrap(spark.createDataFrame(rows, "pos long, p double, won boolean"), 8, 30, 12).first()
    e, stream, scores = [(min(1, max(0, p)) - w) ** 2 for _, p, w in rows], congruence(12, 1), []
    for _ in range(30):
        got = []
        while len(got) < 53:
            s = next(stream) % 53
            got += [e[(s + k) % 53] for k in range(min(8, 53 - len(got)))]
        scores.append(sum(got) / 53)
    scores.sort()
    assert np.allclose([out["mean"], out.p05, out.p95], [sum(scores) / 30, scores[1], scores[28]], rtol=1e-12)
    assert resampling.brier_bootstrap(spark.createDataFrame([], "pos long, p double, won boolean"), 8, 30, 12).collect() == []

    values = {a: [draw.gauss(0, 1) for _ in range(9)] for a in ("x", "y")}
    table = spark.createDataFrame([(a, k, v) for a, d in values.items() for k, v in enumerate(d)], "asset string, pos long, value double")
    stream, want = congruence(3, 1442695040888963407), []
    for path in range(4):
        steps = []
        while len(steps) < 25:  # longer than the series: the circle is walked several times
            s = next(stream) % 9
            steps += [(s + k) % 9 for k in range(min(11, 25 - len(steps)))]
        want += [(path, k, a, values[a][i]) for k, i in enumerate(steps) for a in values]
    assert sorted(map(tuple, resampling.path_returns(table, 11, 25, 4, 3).collect())) == sorted(want)
    assert resampling.path_returns(table.filter("asset = 'x' OR pos > 0"), 11, 25, 4, 3).collect() == []


def test_running_sums_over_spans(spark, monkeypatch):
    monkeypatch.setattr(resampling, "_SPAN", 4)
    rows = [("a", k, float(k * k)) for k in range(23)]
    found = {r["at"]: r.total for r in resampling.running_sums(spark.createDataFrame(rows, "one string, pos long, value double"), "one").collect()}
    assert found == {k: float(sum(i * i for i in range(k))) for k in range(24)}


def plain_isotonic(samples):
    blocks = []
    for s, w in sorted(samples):
        if blocks and blocks[-1][1] == s:
            blocks[-1][2] += 1
            blocks[-1][3] += w
        else:
            blocks.append([s, s, 1, int(w)])
    out = []
    for b in blocks:
        out.append(b)
        while len(out) > 1 and out[-1][3] / out[-1][2] < out[-2][3] / out[-2][2]:
            last = out.pop()
            out[-1] = [out[-1][0], last[1], out[-1][2] + last[2], out[-1][3] + last[3]]
    return out


def test_isotonic_pools_over_ranges(spark):
    draw = random.Random(2)
    samples = [(round(draw.random(), 3), draw.random() < 0.2 + 0.5 * k / 2000) for k in range(2000)]
    for rows in (samples, [(0.2, False), (0.5, False), (0.5, True), (0.9, True)], [(1.0, True), (2.0, False)], [(1.0, True)] * 3):
        want = plain_isotonic(rows)
        df = spark.createDataFrame([*rows, (None, True), (float("nan"), False), (0.1, None)], "score double, won boolean").repartition(3)
        blocks = models.fit_isotonic(df)
        assert sorted([r.low, r.high, r.n, r.won] for r in blocks.collect()) == want
        ask = spark.createDataFrame([(x,) for x in (-1.0, 0.2, 0.35, 0.5, 0.7, 0.9, 1.5, 9.0, None)], "score double")
        xs, ys = [p for b in want for p in b[:2]], [b[3] / b[2] for b in want for _ in (0, 1)]
        for r in models.predict_isotonic(blocks, ask).collect():
            assert r.calibrated is None if r.score is None else abs(r.calibrated - np.interp(r.score, xs, ys)) < 1e-12
    none = models.fit_isotonic(spark.createDataFrame([], "score double, won boolean"))
    assert [r.calibrated for r in models.predict_isotonic(none, spark.createDataFrame([(0.3,)], "score double")).collect()] == [0.5]


@pytest.mark.parametrize("l2", [0.0, 0.7])
def test_logistic_solves_its_equations(spark, l2):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(300, 2)) * [1.0, 3.0]
    y = draw.random(300) < 1 / (1 + np.exp(-(0.3 + x @ [1.1, -0.4])))
    df = spark.createDataFrame([(*map(float, a), bool(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0, True)], "u double, v double, y boolean")
    m = models.fit_logistic(df, ["u", "v"], "y", l2)
    w = np.array(list(m["weights"].values()))
    p = 1 / (1 + np.exp(-(m["intercept"] + x @ w)))
    assert abs((y - p).sum()) < 1e-8 and np.abs(x.T @ (y - p) - l2 * w).max() < 1e-8
    got = df.limit(1).select(models.logistic(m["weights"], m["intercept"]).alias("p")).first().p
    assert got is None or abs(got - p[0]) < 1e-12


def test_logistic_refuses_what_has_no_fit(spark):
    shape = "u double, y boolean"
    assert models.fit_logistic(spark.createDataFrame([], shape), ["u"], "y") is None
    assert models.fit_logistic(spark.createDataFrame([(1.0, True)], shape), ["u"], "y", -1.0) is None
    assert models.fit_logistic(spark.createDataFrame([(0.0, True), (0.0, False)], shape), ["u"], "y") is None
    far = spark.createDataFrame([(800.0,), (-800.0,)], "u double").select(models.logistic({"u": 1.0}).alias("p"))
    assert [r.p for r in far.collect()] == [1.0, 0.0]


def plain_outcome(s, bars, fill):
    side, entry, target, stop, most = s
    sign, mfe, mae = (1 if side == "buy" else -1), 0.0, 0.0
    for age, (o, h, lo, c) in enumerate(bars[: int(most)], 1):
        fav, adv = (h - entry, entry - lo) if sign == 1 else (entry - lo, h - entry)
        mfe, mae = max(mfe, fav), max(mae, adv)
        ht, hs = (h >= target, lo <= stop) if sign == 1 else (lo <= target, h >= stop)
        ot, os_ = sign * (o - target) >= 0, sign * (stop - o) >= 0
        if ht or hs or age >= most:
            win = ot or (not os_ and ((fill == "target_first" or fill == "nearest_to_open" and abs(o - target) < abs(o - stop)) if ht and hs else ht))
            price = (o if ot else target) if win else (o if os_ else stop) if hs else c
            return ("win" if win else "loss" if hs else "expired", price, sign * (price - entry) / abs(entry - stop), age, mfe, mae)
    return ("active", None, None, min(len(bars), int(most)), mfe, mae)


def test_outcomes_equal_a_bar_by_bar_run(spark, monkeypatch):
    monkeypatch.setattr(outcomes, "BUCKET", 7)
    rows, bars = walk(spark, 120, 21)
    draw, setups = random.Random(1), []
    for k in range(150):
        name, at = draw.choice("ab"), draw.randrange(120)
        entry, sign = draw.uniform(80, 120), draw.choice([1, -1])
        ts = DAY + dt.timedelta(hours=at, minutes=draw.choice([0, 30]))  # on a bar or between two
        setups.append((f"s{k}", name, ts, "buy" if sign == 1 else "sell", entry, entry + sign * draw.uniform(1, 12), entry - sign * draw.uniform(1, 6), draw.randint(1, 30), 1.0, 0.5))
    wrong = [("w0", "a", DAY, "hold", 1.0, 2.0, 0.5, 3, 1.0, 1.0), ("w1", "a", DAY, "buy", 1.0, 0.9, 0.5, 3, 1.0, 1.0), ("w2", "a", DAY, "buy", 1.0, 2.0, 0.5, 0, 1.0, 1.0), ("w3", "a", DAY, "sell", 1.0, 0.5, float("nan"), 3, 1.0, 1.0)]
    shape = "id string, series string, ts timestamp_ntz, side string, entry double, target double, stop double, max_bars int, score double, agreement double"
    table = spark.createDataFrame([*setups, *wrong], shape)
    assert [r.e for r in table.filter("id LIKE 'w%'").orderBy("id").select(outcomes.setup_error().alias("e")).collect()] == ["unsupported_trigger", "price_geometry", "zero_duration", "non_finite"]
    for fill in outcomes.FILLS:
        found = {r.id: (r.outcome, r.exit_price, r.realized_r, r.bars, r.mfe, r.mae) for r in outcomes.resolve(table, bars, fill).collect()}
        assert set(found) == {s[0] for s in setups}
        for s in setups:
            after = [r[2:6] for r in rows if r[0] == s[1] and r[1] > s[2]]
            assert found[s[0]] == pytest.approx(plain_outcome(s[3:8], after, fill)), (fill, s)


def plain_lifecycle(kind, top, bottom, bars):
    state, sup, touches, force = "active", kind == "support", 0, 0.0
    for h, lo, c, atr in bars:
        inside = lo <= top and h >= bottom
        through = c < bottom - 0.2 * atr if sup else c > top + 0.2 * atr
        if state == "flipped":
            state = "broken" if through else state
            continue
        if state == "broken":
            if inside and (c < bottom if sup else c > top):
                state, sup, touches = "flipped", not sup, touches + 1
            continue
        left = state == "touched" and (c > top if sup else c < bottom)
        if left:
            state = "reacted"
            force = max(force, abs(c - (top if sup else bottom)) / atr) if atr > 0 else force
        if inside and not left:
            touches, state = touches + 1, "touched"
        if through:
            state = "broken"
    return state, "support" if sup else "resistance", touches, len(bars), force


def test_zone_lifecycles_equal_a_bar_by_bar_run(spark, monkeypatch):
    monkeypatch.setattr(zones, "SPAN", 16)
    rows, bars = walk(spark, 400, 5)
    found = zones.lifecycle(zones.pivot_zones(bars, 3), bars, 60).collect()
    assert {r.state for r in found} == {"active", "touched", "reacted", "broken", "flipped"} or len(found) > 50
    tr = {}
    for name in "ab":
        own = [r for r in rows if r[0] == name]
        trs = [None, *[max(x[3] - x[4], abs(x[3] - p[5]), abs(x[4] - p[5])) for p, x in zip(own, own[1:], strict=False)]]
        for k, x in enumerate(own):
            tr[name, x[1]] = (x[3], x[4], x[5], sum(trs[k - 13 : k + 1]) / 14 if k >= 14 else 0.0)
    for r in found:
        later = [v for (n, t), v in sorted(tr.items()) if n == r.series and t > r.ts][:60]
        assert (r.state, r.present_kind, r.touches, r.age, r.reaction) == pytest.approx(plain_lifecycle(r.kind, r.top, r.bottom, later))


def test_order_blocks_equal_a_bar_by_bar_run(spark, monkeypatch):
    monkeypatch.setattr(zones, "SPAN", 16)
    rows, bars = walk(spark, 300, 9)
    found = {(r.series, r.ts): r for r in zones.order_blocks(bars, 14, 0.8).collect()}
    for name in "ab":
        own, live = [r for r in rows if r[0] == name], []
        for k, (_, ts, o, h, lo, c, _) in enumerate(own):
            got = found[name, ts]
            if k < 14:
                assert got.value is None and got.active_ob_top is None
                continue
            atr = sum(max(x[3] - x[4], abs(x[3] - p[5]), abs(x[4] - p[5])) for p, x in zip(own[k - 14 : k], own[k - 13 : k + 1], strict=True)) / 14
            p, tests = own[k - 1], {1: 0, -1: 0}
            for z in list(live):
                if (c < z[2]) if z[0] == 1 else (c > z[1]):
                    live.remove(z)
                elif (lo <= z[1]) if z[0] == 1 else (h >= z[2]):
                    tests[z[0]] += 1
            side = (1 if c > o and p[5] < p[2] else -1 if c < o and p[5] > p[2] else 0) if abs(c - o) >= 0.8 * atr else 0
            if side:
                live.append((side, p[3], p[4], k))
            assert (got.value, got.retest_bullish, got.retest_bearish) == (sum(z[0] for z in live), tests[1], tests[-1])
            assert (got.active_ob_top, got.active_ob_duration) == ((live[-1][1], k - live[-1][3]) if live else (None, None))


def test_support_and_resistance_by_hand(spark):
    rows, bars = walk(spark, 500, 3)
    found = zones.support_resistance(bars, 4, 0.0025, 0.02).collect()
    for name in "ab":
        own = [r for r in rows if r[0] == name]
        last = own[-1][5]
        for kind, col, sign in (("support", 4, -1), ("resistance", 3, 1)):
            levels = []
            for k in range(4, len(own) - 4):
                near = [r[col] * sign for r in own[k - 4 : k + 5]]
                if own[k][col] * sign == max(near):
                    levels.append((own[k][col] * sign, own[k][1]))
            kept = []
            for key, ts in sorted(levels):
                if kept and abs(kept[-1][0] - key) < 0.02 * last:
                    kept[-1] = (kept[-1][0], min(kept[-1][1], ts))
                else:
                    kept.append((key, ts))
            want = [(k * sign, ts) for k, ts in kept if (k * sign > last if sign == 1 else k * sign < last)][:2]
            assert [(r.price, r.pivot_ts) for r in sorted((r for r in found if r.series == name and r.kind == kind), key=lambda r: r.nth)] == want


def test_merged_zones_cover_their_members(spark):
    _, bars = walk(spark, 300, 4)
    z = zones.pivot_zones(bars, 3)
    merged = zones.merge_zones(z, 0.2).collect()
    assert sum(r.members for r in merged) == z.count()
    for a in merged:
        assert not any(b is not a and (b.series, b.kind) == (a.series, a.kind) and b.bottom <= a.top + 0.2 and a.bottom <= b.top + 0.2 for b in merged)


def test_empty_bars(spark):
    _, bars = walk(spark, 1, 1)
    none = bars.filter(F.lit(False))
    assert zones.order_blocks(none).collect() == zones.support_resistance(none).collect() == zones.lifecycle(zones.pivot_zones(none), none).collect() == []


def plain_divergences(rows, left, right, least, most, prior, source, anchor):
    """rows: (ts, high, low, osc) of one series."""
    live, out, known = [r for r in rows if r[3] is not None], [], {"low": [], "high": []}
    for k in range(left + right, len(live)):
        win, at = live[k - left - right : k + 1], k - right
        c = live[at]
        for side, col, sign in (("low", 2, -1), ("high", 1, 1)):
            line = col if source == "price" else 3
            if not all(sign * r[line] < sign * c[line] for r in win if r is not c):
                continue
            osc = sign * max(sign * r[3] for r in win) if source == "price" and anchor == "extreme" else c[3]
            now, best = (at, c[0], c[col], osc), None
            for p in known[side][-prior:]:
                gap, up, oup = at - p[0], now[2] - p[2], osc - p[3]
                if not least <= gap <= most or not up * oup < 0:
                    continue
                size = min((abs(up) / max(abs(p[2]), 1e-9) + abs(oup) / max(abs(p[3]), 1e-9)) / 2, 1)
                span = max(most - least, 1)
                q = 0.6 * size + 0.4 * (1 - min(abs(gap - least - span / 2) / max(span / 2, 1), 1))
                if best is None or q >= best[-1]:
                    best = (("regular" if up * sign > 0 else "hidden") + ("_bullish" if side == "low" else "_bearish"), p[1], c[0], live[k][0], p[2], c[col], gap, q)
            if best:
                out.append(best)
            known[side].append(now)
    return out


@pytest.mark.parametrize(("source", "anchor"), [("price", "pivot"), ("price", "extreme"), ("oscillator", "pivot")])
def test_divergences_equal_a_plain_engine(spark, source, anchor):
    from tidemark.plans import divergence

    rows, _ = walk(spark, 400, 31)
    draw, osc = random.Random(6), []
    for k, r in enumerate(rows):
        osc.append((r[0], r[1], r[3], r[4], None if k % 400 < 15 or k % 97 == 0 else 50 + r[5] / 10 + draw.gauss(0, 3)))
    df = spark.createDataFrame(osc, "series string, ts timestamp_ntz, high double, low double, osc double")
    found = divergence.divergences(df, 3, 2, 4, 60, 4, source, anchor).collect()
    assert {r.kind for r in found} == {"regular_bullish", "regular_bearish", "hidden_bullish", "hidden_bearish"}
    for name in "ab":
        want = plain_divergences([r[1:] for r in osc if r[0] == name], 3, 2, 4, 60, 4, source, anchor)
        got = [(r.kind, r.previous_ts, r.pivot_ts, r.confirmed_ts, r.previous_price, r.pivot_price, r.bars_between, r.quality) for r in found if r.series == name]
        assert len(got) == len(want)
        for a, b in zip(sorted(got), sorted(want), strict=True):
            assert a[:7] == b[:7] and abs(a[7] - b[7]) < 1e-12


def test_divergence_of_two_lows_by_hand(spark):
    from tidemark.plans import divergence

    points = [(10.0, 50.0), (8.0, 20.0), (11.0, 40.0), (7.0, 30.0), (12.0, 60.0)]
    rows = [("a", DAY + dt.timedelta(hours=k), p + 1, p, o) for k, (p, o) in enumerate(points)]
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, high double, low double, osc double")
    (event,) = divergence.divergences(df, 1, 1, 1, 10, 5).filter("kind LIKE '%bullish'").collect()
    assert (event.kind, event.previous_price, event.pivot_price, event.bars_between, event.confirmed_ts) == ("regular_bullish", 8.0, 7.0, 2, rows[4][1])


def test_values_that_tie_but_for_their_last_bits_are_no_pivots(spark):
    """At sf0.1 two bars have one stochastic RSI, summed in different orders; DuckDB's last bits differ from Spark's."""
    import duckdb

    import __spark_entry__

    folder, db = "/root/testdata/sf0.1", duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
    want = db.execute(__spark_entry__.oracle_sql()["stoch_rsi_divergence"]).fetchall()
    got = [tuple(r) for r in __spark_entry__.queries()["stoch_rsi_divergence"](spark, folder).collect()]
    assert sorted(got) == sorted(want) and len(got) == 272


def test_zone_rejections_by_hand():
    from tidemark.operators.states import rejected_zones

    nan = float("nan")
    # two lows near 10 make a zone; bar 3 dips under it and closes inside, bar 4 closes far below and ends it
    low, close = np.array([10.0, 10.1, 11.0, 9.8, 8.0, 9.9]), np.array([11.0, 11.0, 12.0, 10.5, 8.5, 10.5])
    out = rejected_zones(np.full(6, 13.0), low, close, np.full(6, nan), np.array([10.0, 10.1, nan, nan, nan, nan]), np.full(6, 1.0), 0.25, 2.0, 2, 40)
    assert out[0].tolist() == [0, 0, 0, 1, 0, 0] and out[1][3] == 9.8 and out[2][3] == 0.4 and out[3].tolist() == [0, 1, 1, 1, 0, 0]
    # a zone above, pierced and closed under; wider than allowed, two pivots stay two zones
    high = np.array([20.0, 20.2, 19.0, 20.5])
    bear = rejected_zones(high, np.full(4, 17.0), np.array([19.0, 19.0, 18.0, 19.5]), np.array([20.0, 20.2, nan, nan]), np.full(4, nan), np.full(4, 1.0), 0.25, 2.0, 2, 40)
    assert bear[0].tolist() == [0, 0, 0, -1] and bear[1][3] == 20.5
    wide = rejected_zones(high, np.full(4, 17.0), np.full(4, 18.0), np.array([20.0, 20.2, nan, nan]), np.full(4, nan), np.full(4, 1.0), 0.25, 0.1, 1, 40)
    assert wide[3].tolist() == [1, 2, 2, 2]
