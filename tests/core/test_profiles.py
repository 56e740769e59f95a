"""Rolling profiles against a plain loop over each window."""

import statistics

from test_patterns import bars_frame, walk


def plain_profile(bars, n, rows, share):
    out, was = [], None
    for k in range(len(bars)):
        window = bars[max(0, k - n + 1) : k + 1]
        bottom, top = min(b[3] for b in window), max(b[2] for b in window)
        if k == 0 or top <= bottom:
            out.append(None)
            continue
        step = (top - bottom) / rows
        flow, bought = [0.0] * rows, [0.0] * rows
        for _, _, high, low, close in window:
            for r in range(rows if high > low else 0):
                lo, hi = bottom + r * step, bottom + r * step + step
                part = max(0.0, min(high, hi) - max(low, lo)) / (high - low) * (bottom + (r + 0.5) * step)
                flow[r] += part
                bought[r] += part * min(1.0, max(0.0, (close - low) / (high - low)))
        if max(flow) <= 0:
            out.append(None)
            continue
        poc = max(range(rows), key=lambda r: (flow[r], r))
        inside = {poc}
        while sum(flow[r] for r in inside) < share * sum(flow) - 1e-9 and len(inside) < rows:
            sides = [r for r in (min(inside) - 1, max(inside) + 1) if 0 <= r < rows]
            inside.add(max(sides, key=lambda r: (flow[r], -r)))
        tilt = max(range(rows), key=lambda r: (abs(2 * bought[r] - flow[r]), -r))
        close, vah, val = bars[k][4], bottom + (max(inside) + 1) * step, bottom + min(inside) * step
        bull = sum(bought) / sum(flow) * 100
        events = (False,) * 4 if was is None else (was[0] <= was[1] and close > vah, was[0] >= was[2] and close < val, was[3] <= 50 < bull, was[3] >= 50 > bull)
        out.append((*(round(x, 6) for x in (bottom + (poc + 0.5) * step, vah, val, bottom + (tilt + 0.5) * step, bull)), *events))
        was = (close, vah, val, bull)
    return out


def test_money_flow_profile(spark):
    from tidemark.plans.profiles import money_flow_profile

    series = {"a": walk(3, 160, digits=3), "b": walk(4, 90, 0.05, 3), "one": walk(5, 1), "flat": [(t, 9.0, 9.0, 9.0, 9.0) for t, *_ in walk(1, 5)]}
    series["late"] = [(t, 9.0, 9.0, 9.0, 9.0) for t, *_ in walk(1, 3)] + walk(6, 40, digits=3)[3:]
    found = {}
    for r in money_flow_profile(bars_frame(spark, series), 30, 12, 0.7).orderBy("series", "ts").collect():
        numbers = (r.value, r.vah, r.val, r.delta_poc, r.bull_pct)
        found.setdefault(r.series, []).append(None if r.value is None else (*(round(x, 6) for x in numbers), r.bull_value_area_break, r.bear_value_area_break, r.bull_bias, r.bear_bias))
        assert (r.strength is not None) == bool(r.bull_value_area_break or r.bear_value_area_break) and 0 <= (r.strength or 0) <= 1
    for name, bars in series.items():
        assert found[name] == plain_profile(bars, 30, 12, 0.7), name
    assert found["flat"] == [None] * 5 and found["one"] == [None] and sum(any(x[5:]) for x in found["b"] if x) > 5


def plain_extended(bars, n, rows):
    out = []
    for k in range(len(bars)):
        window = bars[k - n + 1 : k + 1] if k >= n - 1 else []
        bottom, top = (min(b[3] for b in window), max(b[2] for b in window)) if window else (0, 0)
        if top - bottom < 1e-8:
            out.append(None)
            continue
        step = (top - bottom) / rows
        volume, delta = [0.0] * rows, [0.0] * rows
        for _, _, high, low, close, size in window:
            first, last = (min(int((p - bottom) / step), rows - 1) for p in (low, high))
            size, share = (size, (close - low) / (high - low) if high > low else 0.5) if size > 0 else (high - low, 0.5)
            for r in range(first, last + 1):
                volume[r] += size / (last - first + 1)
                delta[r] += size / (last - first + 1) * (2 * share - 1)
        poc = volume.index(max(volume))
        lo = hi = poc
        while sum(volume[lo : hi + 1]) < 0.7 * sum(volume) - 1e-9 and hi - lo + 1 < rows:
            up, down = volume[hi + 1] if hi < rows - 1 else -1, volume[lo - 1] if lo else -1
            lo, hi = (lo, hi + 1) if up >= down else (lo - 1, hi)
        mean = sum(volume) / rows
        names = ["hvn_zone" if v >= 1.5 * mean else "lvn_zone" if v <= 0.5 * mean else None for v in volume]
        zones = []
        for r, name in enumerate(names):
            if name and r and names[r - 1] == name:
                zones[-1][2:] = [round(bottom + (r + 1) * step, 6), zones[-1][3] + volume[r]]
            elif name:
                zones.append([name, round(bottom + r * step, 6), round(bottom + (r + 1) * step, 6), volume[r]])
        zones = [(*z[:3], round(z[3] / sum(volume), 6)) for z in zones]
        out.append(([round(x, 6) for x in (bottom + (poc + 0.5) * step, bottom + (hi + 1) * step, bottom + lo * step)], [round(v, 6) for v in volume], [round(v + 0.0, 6) for v in delta], zones))
    return out


def sized_frame(spark, series):
    from test_patterns import SCHEMA

    rows = [(name, ts, o, high, low, close, float(v)) for name, bars in series.items() for ts, o, high, low, close, v in bars]
    return spark.createDataFrame(rows, SCHEMA)


def sized(seed, n, step=0.02, digits=2):
    """A walk with volumes, some of them zero."""
    return [(ts, o, max(o, h, c), min(o, low, c), c, (7 * k * k + seed) % 11) for k, (ts, o, h, low, c) in enumerate(walk(seed, n, step, digits))]


def test_extended_profile(spark):
    from tidemark.plans.profiles import extended_profile

    series = {"a": sized(3, 120, digits=3), "b": sized(4, 90, 0.05, 3), "short": sized(5, 9), "flat": [(t, 9.0, 9.0, 9.0, 9.0, 2) for t, *_ in walk(1, 40)]}
    found = {}
    for r in extended_profile(sized_frame(spark, series), 30, 13).orderBy("series", "ts").collect():
        zones = [(z.kind, round(z.bottom, 6), round(z.top, 6), round(z.strength, 6)) for z in r.zones or []]
        found.setdefault(r.series, []).append(None if r.value is None else ([round(x, 6) for x in (r.value, r.vah, r.val)], [round(v, 6) for v in r.volumes], [round(v, 6) + 0.0 for v in r.deltas], zones))
    for name, bars in series.items():
        assert found[name] == plain_extended(bars, 30, 13), name
    assert found["flat"] == [None] * 40 and found["short"] == [None] * 9


def plain_persistent(bars, n, width):
    """Bins kept by adding and taking back bars: value, n_bins, threshold, zones by bar, and lives."""
    bins, out, lives = {}, [], []
    grid = [(ts, int(low // width), int(high // width), v if v > 0 else high - low) for ts, _, high, low, _, v in bars]
    for k, (ts, lo, hi, size) in enumerate(grid):
        for b in range(lo, hi + 1):
            bins.setdefault(b, []).append((ts, size / (hi - lo + 1), k))
        if k >= n:
            for b in range(grid[k - n][1], grid[k - n][2] + 1):
                if bins[b][-1][2] == k - n:
                    gone = bins.pop(b)
                    lives.append((b, gone[0][0], gone[-1][0], len(gone), ts))
        if k < n - 1:
            continue
        live = {b: [x for x in rows if x[2] > k - n] for b, rows in bins.items()}
        total = {b: sum(x[1] for x in rows) for b, rows in live.items()}
        rate = {b: total[b] / len(live[b]) for b in live}
        middle = statistics.median(rate.values())
        bound = middle + 2.5 * 1.482602218505602 * statistics.median(abs(x - middle) for x in rate.values())
        most = max(total.values())
        value = (min(b for b in total if total[b] >= most - 1e-9) + 0.5) * width
        zones = sorted((round(b * width, 6), len(live[b]), bins[b][0][0], live[b][-1][0], round(min(rate[b], 1.0), 6)) for b in rate if rate[b] > bound + 1e-9)
        out.append((ts, round(value, 6), len(live), round(bound, 6), zones))
    lives += [(b, rows[0][0], rows[-1][0], len(rows), None) for b, rows in bins.items()]
    return out, lives


def test_persistent_profile(spark):
    from tidemark.plans.profiles import absorption_zones, bin_lives, persistent_profile

    for width in (1.0, 0.25):
        series = {"a": sized(3, 150), "b": sized(8, 90, 0.05), "short": sized(5, 9)}
        bars = sized_frame(spark, series)
        profile, lives = persistent_profile(bars, 20, width), bin_lives(bars, 20, width)
        zones = {}
        for z in absorption_zones(profile, lives, width).collect():
            zones.setdefault((z.series, z.ts), []).append((round(z.bottom, 6), z.touches, z.from_ts, z.last_ts, round(z.strength, 6)))
        rows, kept = profile.orderBy("series", "ts").collect(), lives.collect()
        for name, of in series.items():
            want, lived = plain_persistent(of, 20, width)
            assert [(r.ts, round(r.value, 6), r.n_bins, round(r.threshold, 6), sorted(zones.get((name, r.ts), []))) for r in rows if r.series == name] == want, name
            assert sorted(((r.bin, r.born_ts, r.last_ts, r.touches, r.expired_ts) for r in kept if r.series == name), key=str) == sorted(lived, key=str)
        assert any(zones.values()) and any(r.expired_ts for r in kept)


def test_wide_and_broken_bars(spark):
    """A bar over more bins than allowed, or without numbers, adds nothing and counts for no window."""
    from tidemark.plans.profiles import bin_lives, persistent_profile

    day = walk(1, 5)
    series = {"a": [(day[0][0], 5.0, 6.0, 5.0, 5.5, 2), (day[1][0], 5.0, 1e20, 5.0, 6.0, 2), (day[2][0], 5.0, 6.0, 5.0, 5.5, float("nan")), (day[3][0], 5.0, 5.5, 5.0, 5.2, 4)]}
    bars = sized_frame(spark, series)
    found = persistent_profile(bars, 2).collect()
    assert [(r.ts, r.value, r.n_bins) for r in found] == [(day[3][0], 5.5, 2)]
    assert {(r.bin, r.touches) for r in bin_lives(bars, 2).collect()} == {(5, 2), (6, 1)}
    assert persistent_profile(bars.limit(0), 2).count() == 0 and bin_lives(bars.limit(0), 2).count() == 0
