"""K-d tree sharding by bytes.

Documents are points in a few metadata dimensions of their text (size, bytes per character, lines). A node with several
shards is split along its widest dimension at the weighted median (for an odd number of shards, at that share of its
bytes), until every leaf is one shard. Medians are found by distributed histograms that are refined until the cut's bin
holds next to nothing; only at most `BINS` sums for each open node reach the driver. A 30-bit hash of the text breaks ties
of a dimension, so equal texts always stay together and long runs of one value still split.

A group of equal texts that outweighs a whole shard cannot be split; it gets a shard of its own first (at most shards - 1
of them), and the tree deals the others. The dimensions are functions of the text, so every row finds its leaf by itself.

Null texts count as empty ones (size 1 with the final byte). Empty tables, null or repeated doc_ids are fine; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

BINS = 1024
_UNIT = 1 << 30
#: A cut is good enough when its bin holds less than this share of the node's bytes.
TOLERANCE = 2e-4


def text_dimensions() -> dict[str, Column]:
    """Dimensions of a text (column `text`, not null), each scaled to 0..1 by fixed limits."""
    size = F.octet_length("text")
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return {
        "d_size": F.log2(size + 1.0) / 31,
        "d_wide": F.coalesce(size / F.nullif(F.length("text"), F.lit(0)), F.lit(1.0)) / 4,
        "d_lines": F.log2(lines + 1.0) / 31,
    }


@dataclass
class Node:
    number: int
    shards: list[int]
    dimension: str = ""
    cut: int = 0
    low: int = 0
    high: int = _UNIT * _UNIT
    below: float = 0.0  # weight under `low`
    weight: float = 0.0
    wanted: float = 0.0
    children: list["Node"] = field(default_factory=list)


def _key(dimension: str) -> Column:
    return F.col(dimension) * F.lit(_UNIT) + F.col("tie")


def _place(node: Node, leaf) -> Column:
    """An expression over the tree: `leaf(node)` of the leaf a row falls into."""
    if not node.children:
        return F.lit(leaf(node))
    left, right = node.children
    return F.when(_key(node.dimension) < F.lit(node.cut), _place(left, leaf)).otherwise(_place(right, leaf))


def _split(points: DataFrame, root: Node, open_: list[Node], names: list[str]) -> None:
    """Give each open node its dimension and cut."""
    where = _place(root, lambda n: n.number)
    ranges = [f(c).alias(f"{c}_{k}") for c in names for k, f in (("low", F.min), ("high", F.max))]
    found = {r.node: r for r in points.groupBy(where.alias("node")).agg(F.sum("size").alias("w"), *ranges).collect()}
    for n in open_:
        r = found.get(n.number)
        n.weight = float(r.w) if r else 0.0
        n.dimension = max(names, key=lambda c: r[f"{c}_high"] - r[f"{c}_low"]) if r else names[0]
        n.wanted = n.weight * (len(n.shards) // 2) / len(n.shards)
    active = [n for n in open_ if n.weight]
    while active:
        key = F.coalesce(*[F.when(F.col("node") == n.number, _key(n.dimension)) for n in active])
        low = F.coalesce(*[F.when(F.col("node") == n.number, F.lit(n.low)) for n in active])
        high = F.coalesce(*[F.when(F.col("node") == n.number, F.lit(n.high)) for n in active])
        step = F.coalesce(*[F.when(F.col("node") == n.number, F.lit(-(-(n.high - n.low) // BINS))) for n in active])
        rows = points.select(where.alias("node"), "tie", "size", *names).select("node", "size", key.alias("key"), low.alias("low"), high.alias("high"), step.alias("step"))
        bins = rows.filter("key >= low and key < high").groupBy("node", F.expr("(key - low) div step").alias("bin")).agg(F.sum("size").alias("w")).collect()
        again = []
        for n in active:
            width = -(-(n.high - n.low) // BINS)
            sums = sorted((r.bin, float(r.w)) for r in bins if r.node == n.number)
            for b, w in sums:
                if n.below + w >= n.wanted:
                    break
                n.below += w
            n.low, n.high = n.low + b * width, min(n.high, n.low + (b + 1) * width)
            if width > 1 and w > TOLERANCE * n.weight:
                again.append(n)
            else:
                n.cut = n.low if n.wanted - n.below < n.below + w - n.wanted else n.high
        active = again


def kd_shards(docs: DataFrame, shards: int = 8, dimensions: dict[str, Column] | None = None) -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    dims = dimensions or text_dimensions()
    names = list(dims)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    scaled = [F.least(F.lit(_UNIT - 1), F.greatest(F.lit(0), F.floor(c * _UNIT))).cast("long").alias(k) for k, c in dims.items()]
    hashed = F.xxhash64("text")
    table = settle(
        texts.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), *scaled, hashed.alias("g"), F.shiftrightunsigned(F.xxhash64(F.lit(5), "text"), 34).alias("tie"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")),
        "points",
    )
    # groups that outweigh a shard
    total = float(table.agg(F.sum("size")).first()[0] or 0)
    top = table.groupBy("g", "tie").agg(F.sum("size").alias("w")).orderBy(F.desc("w"), "g", "tie").limit(shards - 1).collect() if shards > 1 else []
    alone, left = [], list(range(shards))
    for r in top:
        if len(left) > 1 and r.w > total / len(left):
            alone.append((r.g, r.tie, left.pop()))
            total -= float(r.w)
    is_alone = [(F.col("g") == g) & (F.col("tie") == t) for g, t, _ in alone]
    points = table
    for test in is_alone:
        points = points.filter(~test)
    # the tree over the others
    root = Node(0, left)
    made, open_ = 1, [root] if len(left) > 1 else []
    while open_:
        _split(points, root, open_, names)
        children = []
        for n in open_:
            half = len(n.shards) // 2
            n.children = [Node(made, n.shards[:half]), Node(made + 1, n.shards[half:])]
            made += 2
            children += n.children
        open_ = [c for c in children if len(c.shards) > 1]
    shard = _place(root, lambda n: n.shards[0])
    for test, (_, _, k) in zip(is_alone, alone, strict=True):
        shard = F.when(test, F.lit(k)).otherwise(shard)
    placed = table.select("doc_id", "size", "text_crc32", "part", "row", shard.cast("int").alias("shard"))
    counts = placed.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("part", "shard").orderBy("row")) - 1
    return placed.join(before, ["part", "shard"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + inside).alias("slot"))
