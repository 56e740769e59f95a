"""Point and figure, sessions, calendars and alerts by hand."""

import datetime as dt

import numpy as np
import pytest

from tidemark.operators.states import box_columns
from tidemark.plans import alerts, pnf, sessions

HOUR = dt.timedelta(hours=1)


def bars_of(spark, closes, start=dt.datetime(2024, 1, 1), step=HOUR):
    rows = [("a", start + k * step, *[float(c)] * 4, 1.0) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def boxes(high, low=None, box=1.0, reversal=3):
    low = high if low is None else low
    out, found = box_columns(np.array(high, float), np.array(low, float), box, reversal), {}
    for k in range(len(high)):
        if out[1][k]:
            found[int(out[0][k])] = ("X" if out[1][k] > 0 else "O", round(out[3][k] / box), round(out[2][k] / box))
    return list(found.values())


def test_columns_of_boxes():
    assert boxes([120.5, 120.9, 123.2]) == [("X", 120, 123)] and boxes([120.5, 120.1, 117.8]) == [("O", 118, 121)]
    assert boxes([100, 111, 108.01]) == [("X", 100, 111)] and boxes([100, 111, 108]) == [("X", 100, 111), ("O", 108, 110)]
    assert boxes([0.0, 0.3, 0.0], box=0.1) == [("X", 0, 3), ("O", 0, 2)]
    assert boxes([100.5, 102, 101.5], [99.5, 98, 97]) == [("O", 97, 98)]  # a bar beyond both sides only widens the start
    assert boxes([100, 105, 106, 106.9, 107, 105], [100, 100, 101, 103, 102, 102.5]) == [("X", 100, 106), ("O", 102, 105), ("X", 103, 105)]
    assert boxes([100, float("nan"), 103]) == [("X", 100, 103)] and boxes([]) == []


def test_horizontal_counts(spark):
    chart = pnf.columns(bars_of(spark, [110.0, 100, 104, 101, 106]), 1.0)
    assert [(r.direction, r.bottom, r.top, r.boxes) for r in chart.orderBy("nth").collect()] == [(-1, 100, 110, 11), (1, 101, 104, 4), (-1, 101, 103, 3), (1, 102, 106, 5)]
    wanted = spark.createDataFrame([("a", 1, 3), ("a", 2, 4), ("a", 1, 2), ("a", 3, 1), ("a", 1, 9)], "series string, first long, last long")
    base, top = pnf.horizontal_counts(chart, wanted, 1.0).orderBy("first").collect()
    assert (base.direction, base.count_line, base.extreme, base.columns, base.columns_on_line, base.effect, base.target_from_extreme, base.target_from_line) == (1, 101, 100, 3, 3, 9, 109, 110)
    assert (top.direction, top.count_line, top.extreme, top.columns_on_line, top.target_from_line) == (-1, 106, 106, 1, 97)


def test_sessions_over_midnight_and_the_change_of_clocks(spark):
    # New York moves its clocks on 10 March 2024: an evening session opens at 23:00 UTC before and at 22:00 UTC after
    rows = sessions.with_sessions(bars_of(spark, [float(k) for k in range(72)], dt.datetime(2024, 3, 9)), "18:00", "03:00", "America/New_York", 60).orderBy("ts").collect()
    opened = [r.ts for r in rows if r.new_session]
    assert opened == [dt.datetime(2024, 3, 9, 0), dt.datetime(2024, 3, 9, 23), dt.datetime(2024, 3, 10, 22), dt.datetime(2024, 3, 11, 22)]
    assert {r.session for r in rows if r.in_session and r.ts < dt.datetime(2024, 3, 9, 8)} == {dt.datetime(2024, 3, 8, 23)}
    at = {r.ts: r for r in rows}
    assert not at[dt.datetime(2024, 3, 9, 8)].in_session and at[dt.datetime(2024, 3, 9, 7)].in_session
    assert at[dt.datetime(2024, 3, 9, 1)].opening_high is None  # its first hour lies before the data
    first = at[dt.datetime(2024, 3, 9, 23)]
    assert first.in_opening and first.opening_high == 23.0
    assert at[dt.datetime(2024, 3, 10, 12)].opening_high == 23.0 and not at[dt.datetime(2024, 3, 10, 12)].in_session  # stays until the next session


def test_whole_days_and_wrong_clocks(spark):
    rows = sessions.with_sessions(bars_of(spark, [1.0] * 50), zone="+05:30").orderBy("ts").collect()
    assert sum(r.new_session for r in rows) == 3 and all(r.in_session for r in rows)
    with pytest.raises(ValueError):
        sessions.session_open(None, "24:00")


def test_session_vwap(spark):
    rows = sessions.session_vwap(sessions.with_sessions(bars_of(spark, [1.0, 2.0, 3.0] * 16), "00:00", "02:00")).orderBy("ts").collect()
    assert [r.vwap for r in rows[:3]] == [1.0, 1.5, None] and [r.vwap for r in rows[24:27]] == [1.0, 1.5, None]


def test_exchange_calendar(spark):
    utc = lambda *a: (dt.datetime(*a),)
    rows = spark.createDataFrame([utc(2024, 1, 15, 14, 30), utc(2024, 7, 15, 13, 30), utc(2024, 7, 15, 13, 29), utc(2024, 6, 10, 20, 0), utc(2024, 7, 4, 16, 0), utc(2024, 11, 29, 17, 59), utc(2024, 11, 29, 18, 0)], "ts timestamp_ntz")
    day = lambda *a: spark.createDataFrame([(dt.date(*a),)], "day date")
    early = spark.createDataFrame([(dt.date(2024, 11, 29), "13:00")], "day date, close string")
    found = sessions.with_calendar(rows, [("09:30", "16:00")], "America/New_York", day(2024, 7, 4), early).orderBy("ts").collect()
    assert [r.is_open for r in found] == [True, False, False, False, True, True, False]
    assert [r.is_holiday for r in found].index(True) == 2
    assert found[0].local_ts == dt.datetime(2024, 1, 15, 9, 30)


def test_alerts_have_stable_identities(spark):
    rows = spark.createDataFrame([("DAX", dt.datetime(2024, 1, 1), 1.0, 0.4), ("ES", dt.datetime(2024, 1, 1), -1.0, 0.6), ("ES", dt.datetime(2024, 1, 2), None, None)], "series string, ts timestamp_ntz, value double, strength double")
    found = alerts.events(rows, alerts.RULES["zone_rejection"], "zone_rejection", "5m")
    got = sorted((r.event_id, r.kind, r.strength) for r in found.collect())
    assert got == [("2#ES:2#5m:20#bear_failed_breakout:7#trigger:1704067200", "bear_failed_breakout", 0.6), ("3#DAX:2#5m:20#bull_failed_breakout:7#trigger:1704067200", "bull_failed_breakout", 0.4)]
    assert alerts.unique(found.union(found)).count() == 2
    other = alerts.events(rows, alerts.RULES["zone_rejection"], "zone_rejection", "15m")
    assert alerts.unique(found.union(other)).count() == 4
    with pytest.raises(ValueError):
        alerts.events(rows, [], "x", phase="later")


def test_rules_fit_their_tables(spark):
    from tidemark.operators.spec import apply, build
    from tidemark.plans import divergence, zones
    from tidemark.sources.bars import event_bars

    bars = event_bars(spark, "/root/testdata/sf0.001")
    tables = {"zone_rejection": apply(bars, [build("zone_rejection")]), "order_block": zones.order_blocks(bars), "divergence": divergence.divergence_bars(bars), "point_and_figure": apply(bars, [build("pnf", box_size=5.0)])}
    assert set(tables) == set(alerts.RULES)
    for name, rows in tables.items():
        alerts.events(rows, alerts.RULES[name], name, "1h").collect()
