"""Bars (series, ts, open, high, low, close, volume) from the driver tables, their validity and resampling.

Open and close are the first and last price by time. `events` and `orders` have a total order within a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = ("series", "ts", "open", "high", "low", "close", "volume")


def aggregate_bars(rows: DataFrame, series: Column, ts: Column, price: Column, volume: Column | None, unit: str) -> DataFrame:
    """One bar for each series and calendar unit; partial aggregation runs before the one shuffle."""
    columns = rows.select(series.alias("series"), F.date_trunc(unit, ts).cast("timestamp_ntz").alias("bucket"), ts.alias("at"), price.cast("double").alias("price"), (volume if volume is not None else F.lit(1.0)).cast("double").alias("size"))
    return columns.groupBy("series", F.col("bucket").alias("ts")).agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.sum("size").alias("volume")
    )


def is_valid_bar() -> Column:
    """Finite positive prices, a non-negative volume, and low and high around open and close."""
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    fine = F.lit(True)
    for p in prices:
        fine = fine & p.isNotNull() & ~F.isnan(p) & (p > 0) & (p < float("inf"))
    volume = F.col("volume")
    sized = volume.isNull() | F.isnan(volume) | ((volume >= 0) & (volume < float("inf")))
    return fine & sized & (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close"))


def event_bars(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "value")
    return aggregate_bars(events, F.col("event_type"), F.col("ts"), F.col("value"), None, unit).filter(is_valid_bar())


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    columns = orders.select(F.col("o_orderpriority").alias("series"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))
    return columns.groupBy("series", "ts").agg(F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.count(F.lit(1)).cast("double").alias("volume")).filter(is_valid_bar())


#: The same bars for DuckDB.
EVENT_BARS_SQL = """SELECT event_type AS series, date_trunc('{unit}', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high,
 min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2 HAVING min(value) > 0"""
ORDER_BARS_SQL = """SELECT o_orderpriority AS series, date_trunc('day', o_orderdate) AS ts, arg_min(o_totalprice, o_orderkey) AS open,
 max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS volume
 FROM orders GROUP BY 1, 2 HAVING min(o_totalprice) > 0"""


def resample(bars: DataFrame, seconds: int) -> DataFrame:
    """Wider bars on an epoch-aligned grid; open and close by time, so the input order does not matter."""
    epoch = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    bucket = F.timestamp_seconds(F.floor(epoch / seconds) * seconds).cast("timestamp_ntz")
    return bars.groupBy("series", bucket.alias("bucket")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_bars")
    ).withColumnRenamed("bucket", "ts")


def first_invalid(bars: DataFrame) -> DataFrame:
    """Bars before each series' first invalid one (a checked run stops there)."""
    w = Window.partitionBy("series").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumn("_ok", F.min(is_valid_bar().cast("int")).over(w)).filter("_ok = 1").drop("_ok")
