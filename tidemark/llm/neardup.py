"""MinHash near-duplicate search with odd sketches, exact confirmation and connected components.

Documents whose distinct word shingles have a Jaccard similarity of at least a threshold are linked. Banded MinHash
proposes candidates, odd sketches (parity bitmaps of the samples) drop most of the wrong ones by an XOR and a population
count, and the full shingle sets decide. A band's bucket never becomes all its pairs:

1. documents with equal sets are one class, found by grouping on a 128-bit hash of the set;
2. buckets with the same members are one bucket;
3. each bucket compares its members with one leader, the member with the most company over all buckets;
4. only buckets whose members still lie in several components are looked at again, those outside the bucket's largest
   component against all members, in blocks of bounded size, inside which links are found by matrix products and only
   a spanning set of them leaves the task.

So no link between different texts that the bands propose is lost, and hot groups stay linear.

Nulls, ties: a null or empty text (or one without words) has an empty set and links with nothing. Rows with a null doc_id
are kept, without a component. Rows that share a doc_id count as one document. Other columns are ignored here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import minhash as M
from .common import drop_settled, lookup_join, map_batches, settle, text_bytes
from .components import connected_components

#: A bucket is dealt to one more task for every so many members; bucket keys are dealt over SALTS tasks while sizes are unknown.
HOT, SALTS = 1024, 8
#: Members outside the largest component, and members of any kind, that one task compares.
OWN_BLOCK, ALL_BLOCK = 256, 512
_NONE = b""


def signatures(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, set_hash (null if empty), sketch (8 longs), bands (25 longs)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, hashes, sketches, keys = [], [], [], []
        for text in text_bytes(batch.column(1)):
            s = M.shingle_set(text)
            n.append(len(s))
            if not len(s):
                hashes.append(None), sketches.append(None), keys.append(None)
                continue
            sig = M.signature(s)
            hashes.append(xxhash.xxh3_128_digest(s.tobytes()))
            sketches.append(np.frombuffer(M.odd_sketch(sig), np.int64))
            keys.append(M.bands(sig).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.binary()), pa.array(sketches, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_hash", "sketch", "bands"])

    schema = "doc_id long, n_shingles long, set_hash binary, sketch array<long>, bands array<long>"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def flips(a: str, b: str):
    """Population count of the XOR of two sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, bits): the shingle sets, as bytes, of the wanted (rep, set_hash, doc_id)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        reps, sets = [], []
        for rep, want, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
            data = M.shingle_set(text).tobytes()
            if xxhash.xxh3_128_digest(data) == want:
                reps.append(rep), sets.append(data)
        return pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(sets, pa.binary())], ["rep", "bits"])

    joined = docs.select(F.col("doc_id").cast("long"), "text").join(wanted, "doc_id").select("rep", "set_hash", "text")
    return map_batches(joined, run, "rep long, bits binary").dropDuplicates(["rep"])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True)) if percent * max(len(p), len(q)) <= 100 * min(len(p), len(q)) else 0
            keep.append(100 * both >= percent * (len(p) + len(q) - both))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.withColumnsRenamed({"rep": "a", "bits": "bits_a"})
    right = sets.withColumnsRenamed({"rep": "b", "bits": "bits_b"})
    return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "bits_a", "bits_b"), run, "a long, b long")


def _block_near(most: int):
    """The members of one block that have a candidate among the others of it."""

    def run(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.own.to_numpy()
        sketches, comps = np.array(frame.sketch.tolist(), np.int64).view(np.uint64).reshape(len(frame), -1), frame.comp.to_numpy()
        hit = np.zeros(len(frame), bool)
        rest = np.flatnonzero(~own)
        for i in np.flatnonzero(own):
            near = (np.bitwise_count(sketches[rest] ^ sketches[i]).sum(axis=1) <= most) & (comps[rest] != comps[i])
            hit[rest[near]] = True
            hit[i] = near.any()
        return frame[hit]

    return run


def _block_links(percent: int, most: int):
    """Links between members of different components in one block of one bucket."""

    def run(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own = frame[frame.own].reset_index(drop=True)
        rest = frame[~frame.own].reset_index(drop=True)
        if own.empty or rest.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sk = [np.array(f.sketch.tolist(), np.int64).view(np.uint64) for f in (own, rest)]
        comps = [f.comp.to_numpy() for f in (own, rest)]
        near = np.zeros((len(own), len(rest)), bool)
        for i in range(len(own)):
            near[i] = np.bitwise_count(sk[1] ^ sk[0][i]).sum(axis=1) <= most
        near &= comps[0][:, None] != comps[1][None, :]
        rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if not len(rows):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sets = [[np.frombuffer(f.bits[i], np.uint64) for i in at] for f, at in ((own, rows), (rest, cols))]
        sizes = [np.array([len(s) for s in x]) for x in sets]
        shared = np.intersect1d(np.concatenate(sets[0]), np.concatenate(sets[1]))
        common = np.zeros((len(rows), len(cols)), np.float32)
        for at in range(0, len(shared), 4096):
            part = shared[at : at + 4096]
            held = [np.stack([np.isin(part, s, assume_unique=True) for s in x]).astype(np.float32) for x in sets]
            common += held[0] @ held[1].T
        union = sizes[0][:, None] + sizes[1][None, :] - common
        ok = near[np.ix_(rows, cols)] & (100 * common >= percent * union)
        a, b, root = [], [], {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        for i, j in zip(*np.nonzero(ok), strict=True):
            p, q = find(comps[0][rows[i]]), find(comps[1][cols[j]])
            if p != q:
                root[max(p, q)] = min(p, q)
                a.append(int(comps[0][rows[i]])), b.append(int(comps[1][cols[j]]))
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    return run


def _left_over(members: DataFrame, reps: DataFrame, sets: DataFrame, comps: DataFrame, percent: int, most: int) -> DataFrame:
    """Links (between component ids) that buckets with several components still hold."""
    placed = _dealt(members).join(comps.withColumnsRenamed({"node": "rep"}), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    shares = placed.groupBy("bkey", "comp").agg(F.count(F.lit(1)).alias("m"))
    open_ = shares.groupBy("bkey").agg(F.max(F.struct("m", "comp")).alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("m").alias("n")).filter("parts > 1 and n > 2")
    block = lambda size, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), size).cast("int")
    rows = (
        placed.drop("n").join(_spread(open_), ["bkey", "salt"])
        .withColumn("outside", F.col("comp") != F.col("top.comp"))
        .withColumn("nb", F.ceil((F.col("n") - F.col("top.m")) / OWN_BLOCK).cast("int"))
        .withColumn("na", F.ceil(F.col("n") / ALL_BLOCK).cast("int"))
    )
    own = rows.filter("outside").select("bkey", block(F.col("nb"), 1).alias("bi"), F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("bj"), "rep", "comp", F.lit(True).alias("own"))
    rest = rows.select("bkey", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("bi"), block(F.col("na"), 2).alias("bj"), "rep", "comp", F.lit(False).alias("own"))
    narrow = own.union(rest).join(reps.select("rep", "sketch"), "rep").select("bkey", "bi", "bj", "rep", "comp", "own", "sketch")
    near = narrow.groupBy("bkey", "bi", "bj").applyInPandas(_block_near(most), narrow.schema)
    return near.join(sets, "rep").groupBy("bkey", "bi", "bj").applyInPandas(_block_links(percent, most), "a long, b long").distinct()


def _ways() -> Column:
    return F.ceil(F.col("n") / HOT).cast("int")


def _dealt(members: DataFrame) -> DataFrame:
    """Members with the part of their bucket that they fall into."""
    return members.withColumn("salt", F.pmod(F.xxhash64("rep"), _ways()).cast("int"))


def _spread(buckets: DataFrame) -> DataFrame:
    """One row of a bucket for each of its parts."""
    return buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), _ways() - 1)))


def _shared_ids(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) between the classes that the rows of one doc_id belong to."""
    several = known.groupBy("doc_id").agg(F.min("set_hash").alias("low"), F.max("set_hash").alias("high")).filter("low <> high").select("doc_id")
    held = known.join(several, "doc_id").select("doc_id", "set_hash").distinct().join(classes.select("set_hash", "rep"), "set_hash").select("doc_id", "rep")
    return held.join(held.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b")).filter("a <> b")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept, class_id.

    class_id is the smallest doc_id with the same shingle set, component_id the smallest one reachable over links with
    100 * intersection >= percent * union, kept whether the row is its component's representative. The bands are laid
    out for similarities of 0.8 and more.
    """
    most = M.most_flips(percent / 100)
    table = settle(signatures(docs), "signatures")
    known = table.filter("doc_id is not null and set_hash is not null")
    classes = settle(known.groupBy("set_hash").agg(F.min("doc_id").alias("class_id")).withColumn("rep", F.monotonically_increasing_id()), "classes")
    named = classes.withColumnRenamed("class_id", "doc_id")
    reps = settle(known.join(named, ["set_hash", "doc_id"]).dropDuplicates(["rep"]).select("rep", "set_hash", "doc_id", "sketch", "bands"), "reps")

    banded = reps.select("rep", F.explode("bands").alias("bkey"))
    who = F.xxhash64("rep")
    buckets = banded.groupBy("bkey").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(who).alias("x"), F.sum(F.shiftright(who, 20)).alias("y")).filter("n > 1")
    single = buckets.groupBy("n", "x", "y").agg(F.min("bkey").alias("bkey"))
    salted = single.select("bkey", "n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    members = settle(banded.withColumn("salt", F.pmod(who, F.lit(SALTS)).cast("int")).join(salted, ["bkey", "salt"]).select("bkey", "rep", "n"), "members")

    company = members.groupBy("rep").agg(F.sum("n").alias("company"))
    leaders = members.join(company, "rep").groupBy("bkey", "n").agg(F.max(F.struct("company", (-F.col("rep")).alias("minus"))).alias("top")).select("bkey", "n", (-F.col("top.minus")).alias("leader"))
    pairs = _dealt(members).join(_spread(leaders).drop("n"), ["bkey", "salt"]).filter("rep <> leader").select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
    sketch = reps.select("rep", "sketch")
    pairs = pairs.join(sketch.withColumnsRenamed({"rep": "a", "sketch": "sketch_a"}), "a").join(sketch.withColumnsRenamed({"rep": "b", "sketch": "sketch_b"}), "b")
    pairs = pairs.filter(flips("sketch_a", "sketch_b") <= most).select("a", "b")
    in_buckets = reps.select("rep", "set_hash", "doc_id").join(members.select("rep").distinct(), "rep", "left_semi")
    sets = settle(_full_sets(docs, in_buckets), "sets")
    links = settle(_confirm(pairs, sets, percent).union(_shared_ids(known, classes)), "links")
    comps = connected_components(links)
    more = settle(_left_over(members, reps, sets, comps, percent, most), "links")
    merged = connected_components(more).select(F.col("node").alias("comp"), F.col("comp").alias("whole"))
    placed = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("linked", F.col("comp").isNotNull()).withColumn("comp", F.coalesce("comp", "rep"))
    placed = placed.join(merged, "comp", "left").select("set_hash", "class_id", "rep", (F.col("linked") | F.col("whole").isNotNull()).alias("linked"), F.coalesce("whole", "comp").alias("whole"))
    names = settle(placed.filter("linked").groupBy("whole").agg(F.min("class_id").alias("component_id")), "names")
    final = lookup_join(placed, names, "whole", salt=F.col("rep"), salts=SALTS).select("set_hash", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    final = settle(final, "components")
    drop_settled(docs.sparkSession, reps, members, sets, links, more)
    out = table.select("doc_id", "n_shingles", "set_hash").join(final, "set_hash", "left")
    mine = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", mine.alias("component_id"), F.coalesce(F.col("doc_id") == mine, F.lit(True)).alias("kept"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
