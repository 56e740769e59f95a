"""Connected components over an edge table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_settled, settle


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for each node of `edges` (a, b), comp the smallest node reachable.

    Each round gives a node and its present root the smallest label among the neighbours, then looks labels up twice
    (pointer jumping), so a chain of n nodes needs about log n rounds. Labels are settled each round in the shared
    folder; only the number of changes reaches the driver. An empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        found = near.join(labels, "node").filter("other < comp")
        hooks = found.select("node", "other").union(found.select(F.col("comp").alias("node"), "other")).groupBy("node").agg(F.min("other").alias("other"))
        hooked = labels.join(hooks, "node", "left").select("node", F.least("comp", "other").alias("comp"))
        hooked = settle(hooked, "labels")
        jump = hooked.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        after = hooked.join(jump, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
        after = settle(after, "labels")
        changed = after.join(labels.withColumnRenamed("comp", "old"), "node").filter("old <> comp").limit(1).count()
        drop_settled(spark, labels, hooked)
        labels = after
        if not changed:
            drop_settled(spark, both)
            return labels
