"""Trading sessions as columns: sessions over midnight and daylight saving, opening ranges, exchange calendars.

Times in bars are UTC. A session is named by the UTC time it opens at; everything else is windows over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_DAY = 86_400


def _seconds(clock: str) -> int:
    hour, minute = (int(x) for x in clock.split(":"))
    if not (0 <= hour <= 23 and 0 <= minute <= 59):
        raise ValueError(f"{clock!r} is no time of day")
    return hour * 3600 + minute * 60


def local_time(ts: Column, zone: str) -> Column:
    """Clock time of a UTC time in a zone: a name such as America/New_York, or an offset such as +05:30."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def session_open(ts: Column, start: str = "00:00", end: str = "00:00", zone: str = "UTC") -> Column:
    """The UTC time at which the session of `ts` opened; null outside sessions. Equal start and end: the whole local day.

    A session that ends before it starts runs over midnight and belongs to the day it starts on.
    """
    a, z = _seconds(start), _seconds(end)
    local = local_time(ts, zone)
    day = F.to_date(local)
    second = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    if a == z:
        opened = day
    elif a < z:
        opened = F.when((second >= a) & (second < z), day)
    else:
        opened = F.when(second >= a, day).when(second < z, F.date_sub(day, 1))
    at = F.timestamp_add("SECOND", F.lit(a), opened.cast("timestamp_ntz"))
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), at)


def with_sessions(bars: DataFrame, start: str = "00:00", end: str = "00:00", zone: str = "UTC", opening_minutes: int = 30) -> DataFrame:
    """`bars` with session (its open), in_session, new_session, in_opening, opening_high and opening_low.

    The opening range holds the session's bars so far within `opening_minutes` of its open; after the session its last values
    stay until the next one begins.
    """
    w = Window.partitionBy("series").orderBy("ts")
    rows = bars.withColumn("session", session_open(F.col("ts"), start, end, zone))
    rows = rows.withColumn("held", F.last("session", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.col("session").isNotNull()
    elapsed = F.timestamp_diff("SECOND", F.col("session"), F.col("ts"))
    rows = rows.withColumn("in_opening", F.coalesce(inside & (elapsed >= 0) & (elapsed < opening_minutes * 60), F.lit(False)))
    so_far = Window.partitionBy("series", "held").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag("held").over(w)
    return rows.select(
        *bars.columns, "session", inside.alias("in_session"), (inside & (before.isNull() | (before != F.col("held")))).alias("new_session"), "in_opening",
        F.max(F.when(F.col("in_opening"), F.col("high"))).over(so_far).alias("opening_high"), F.min(F.when(F.col("in_opening"), F.col("low"))).over(so_far).alias("opening_low"),
    )


def session_vwap(sessions: DataFrame) -> DataFrame:
    """(series, ts, session, vwap): mean typical price by volume since the session's open; null outside and without volume."""
    so_far = Window.partitionBy("series", "session").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    volume = F.sum("volume").over(so_far)
    return sessions.select("series", "ts", "session", F.when(F.col("session").isNotNull() & (volume > 0), F.sum(typical * F.col("volume")).over(so_far) / volume).alias("vwap"))


def with_calendar(rows: DataFrame, segments: list[tuple[str, str]], zone: str, holidays: DataFrame, early_closes: DataFrame) -> DataFrame:
    """`rows` with local_ts, is_holiday and is_open by an exchange's calendar.

    `segments` are the day's (start, end) in local time, ends excluded. `holidays` (day) closes whole local days;
    `early_closes` (day, close as HH:MM) ends the first segment early and drops the others. Both are joined by the local day.
    """
    rows = rows.withColumn("local_ts", local_time(F.col("ts"), zone))
    local = F.col("local_ts")
    second = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    parts = F.split(F.col("close"), ":")
    early = early_closes.groupBy(F.col("day").alias("day__")).agg(F.min(parts[0].cast("int") * 3600 + parts[1].cast("int") * 60).alias("until__"))
    closed = holidays.select(F.col("day").alias("day__"), F.lit(True).alias("closed__")).distinct()
    joined = rows.withColumn("day__", F.to_date(local)).join(closed, "day__", "left").join(early, "day__", "left")
    spans = [(_seconds(a), _seconds(z)) for a, z in segments]
    usual = F.lit(False)
    for a, z in spans:
        usual = usual | ((second >= a) & (second < z))
    short = (second >= spans[0][0]) & (second < F.col("until__")) if spans else F.lit(False)
    holiday = F.coalesce("closed__", F.lit(False))
    return joined.select(*rows.columns, holiday.alias("is_holiday"), (~holiday & F.when(F.col("until__").isNotNull(), short).otherwise(usual)).alias("is_open"))
