"""Point and figure: columns of boxes made by price moves, and horizontal counts over them.

One fold over a series gives the state after each bar (operator `point_and_figure`); columns and counts are aggregations of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import swings  # noqa: F401  its operators register themselves
from ..operators.spec import apply, build


def columns(bars: DataFrame, box: float = 1.0, reversal: int = 3, method: str = "close") -> DataFrame:
    """(series, nth, direction, top, bottom, boxes, first_bar, last_bar): each column in its last state; bars count from 0."""
    op = build("point_and_figure", box_size=float(box), reversal=reversal, method={"close": 0.0, "high_low": 1.0}[method])
    states = apply(bars, [op], ["series", "ts", "i"]).filter("changed = 1")
    last = F.max_by(F.struct("value", "top", "bottom", "boxes"), "i").alias("c")
    found = states.groupBy("series", F.col("column").cast("long").alias("nth")).agg(last, F.min("i").alias("a"), F.max("i").alias("z"))
    return found.select("series", "nth", F.col("c.value").cast("int").alias("direction"), F.col("c.top").alias("top"), F.col("c.bottom").alias("bottom"), F.col("c.boxes").cast("long").alias("boxes"), (F.col("a") - 1).cast("long").alias("first_bar"), (F.col("z") - 1).cast("long").alias("last_bar"))


def horizontal_counts(chart: DataFrame, wanted: DataFrame, box: float = 1.0, reversal: int = 3) -> DataFrame:
    """For each wanted (series, first, last): count line, extreme, columns and columns on the line, their effects and targets.

    The line is the last column's low if it falls, else its high; a base projects up and a top down. Ranges that are not in
    the chart, run backwards or have ends of different directions give no row.
    """
    half = box / 2
    ends = chart.select("series", F.col("nth").alias("first"), F.col("direction").alias("begin"))
    ends = wanted.filter("first <= last").join(ends, ["series", "first"]).join(chart.select("series", F.col("nth").alias("last"), "direction", F.when(F.col("direction") < 0, F.col("bottom")).otherwise(F.col("top")).alias("line")), ["series", "last"]).filter("begin = direction")
    each = ends.withColumn("nth", F.explode(F.sequence("first", "last"))).join(chart.select("series", "nth", "top", "bottom"), ["series", "nth"])
    base = F.col("direction") < 0
    on = (F.col("bottom") <= F.col("line") + half) & (F.col("top") >= F.col("line") - half)
    sums = each.groupBy("series", "first", "last", "direction", "line").agg(F.count(F.lit(1)).alias("columns"), F.sum(on.cast("long")).alias("columns_on_line"), F.min("bottom").alias("low"), F.max("top").alias("high"))
    sign, extreme = F.when(base, 1.0).otherwise(-1.0), F.when(base, F.col("low")).otherwise(F.col("high"))
    effect, on_line = F.col("columns") * (reversal * box), F.col("columns_on_line") * (reversal * box)
    return sums.select("series", "first", "last", (-F.col("direction")).alias("direction"), F.col("line").alias("count_line"), extreme.alias("extreme"), "columns", "columns_on_line", effect.alias("effect"), on_line.alias("effect_on_line"), (extreme + sign * effect).alias("target_from_extreme"), (F.col("line") + sign * effect).alias("target_from_line"))
