"""Streaming forms: bars by event-time windows, and recurrences as keyed state with the batch kernels' results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_bars(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars of a stream (series, ts timestamp, price, size); rows later than the watermark are dropped by Spark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "series")
    return w.agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("size").alias("volume")).select("series", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_ema(bars: DataFrame, period: int = 20) -> DataFrame:
    """(series, ts, close, value) with an exponential mean kept in state across micro-batches.

    A row at or before the last confirmed ts of its series is late: it is returned with a null value and changes nothing.
    The state is three numbers for each series.
    """
    alpha = 2 / (period + 1)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean, last, count = state.get if state.exists else (float("nan"), -1, 0)
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        values = []
        for at, close in zip(rows.ts.astype("int64"), rows.close, strict=True):
            if at <= last:
                values.append(None)
                continue
            mean = close if count == 0 else mean + alpha * (close - mean)
            last, count = int(at), count + 1
            values.append(mean if count >= period else None)
        state.update((float(mean), int(last), int(count)))
        yield pd.DataFrame({"series": rows.series, "ts": rows.ts, "close": rows.close, "value": pd.Series(values, dtype="float64", index=rows.index)})

    return bars.groupBy("series").applyInPandasWithState(update, "series string, ts timestamp, close double, value double", "mean double, last long, count long", "append", GroupStateTimeout.NoTimeout)


def distinct_events(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first of events with equal identity within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
