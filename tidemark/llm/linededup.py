"""Corpus-wide line removal with two Bloom filters.

A first pass fills two Bloom filters, one of line keys seen and one of keys seen again; filters of different tasks merge
by OR, and what two tasks have both seen is seen again. Only lines that the second filter suspects leave the tasks, as
128-bit keys, for exact counting. So false positives cost a little shuffle and never change a result.

A line's key is the line with ASCII white space stripped at both ends and A-Z lower-cased. A key counts once for each row
of the table it occurs in. Null and empty texts are one empty line, which has no key; a null text stays null. Repeated rows
count each by itself, as do null doc_ids; an empty table stays empty; long texts take memory in proportion. Other columns
stay as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, in_parts, lookup_join, settle, shared_dir, sheltered, text_bytes

HASHES = 4
#: Bits for each expected key, and the bounds of a filter: 128 KB to 32 MB. A filter that more keys fill up suspects more lines; the result stays exact.
BITS_PER_KEY, MIN_BITS, MAX_BITS = 16, 1 << 20, 1 << 28
#: Filters travel in segments of so many bits, empty ones not at all.
SEGMENT = 1 << 15
#: Filters of more tasks than this are merged in two steps. What a task sends follows the lines it has read.
MERGED = 256
#: Removed keys are broadcast (16 bytes each) after a count shows at most so many; beyond, a join finds the lines.
BROADCAST_KEYS = 500_000


def key_digests(text: bytes, min_chars: int) -> list[bytes | None]:
    """The 128-bit digest of each line's key; None where the key is too short."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(ASCII_SPACE).lower()
        short = not key or min_chars > 1 and len(key.decode()) < min_chars
        out.append(None if short else xxhash.xxh3_128_digest(key))
    return out


def _positions(digests: list[bytes], bits: int) -> np.ndarray:
    """(n, HASHES) bit positions by double hashing."""
    halves = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    steps = np.arange(HASHES, dtype=np.uint64)
    return (halves[:, :1] + steps * (halves[:, 1:] | np.uint64(1))) & np.uint64(bits - 1)


def _test(bloom: np.ndarray, digests: list[bytes]) -> np.ndarray:
    at = _positions(digests, len(bloom) * 8)
    return ((bloom[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _set(bloom: np.ndarray, digests: list[bytes]) -> None:
    at = _positions(digests, len(bloom) * 8).ravel()
    np.bitwise_or.at(bloom, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def seen_twice(docs: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """The filter of keys that at least two rows may hold; `bits` bounds its size."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in in_parts(batches):
            keys = [k for text in text_bytes(batch.column(0)) for k in dict.fromkeys(key_digests(text, min_chars)) if k]
            if not keys:
                continue
            new = list(dict.fromkeys(keys))
            here = pd.Series(keys).value_counts()
            again = [k for k in here.index[here.to_numpy() > 1]]
            known = _test(once, new)
            _set(twice, [k for k, seen in zip(new, known, strict=True) if seen] + again)
            _set(once, new)
        size = SEGMENT // 8
        for at in range(0, bits // 8, size):
            a, b = once[at : at + size], twice[at : at + size]
            if a.any():
                yield pa.RecordBatch.from_arrays([pa.array([at // size], pa.int64()), pa.array([zlib.compress(a.tobytes(), 1)], pa.binary()), pa.array([zlib.compress(b.tobytes(), 1)], pa.binary())], ["segment", "once", "twice"])

    def merge(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(SEGMENT // 8, np.uint8), np.zeros(SEGMENT // 8, np.uint8)
        for a, b in zip(frame.once, frame.twice, strict=True):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            twice |= b | (once & a)
            once |= a
        return pd.DataFrame({"segment": [keys[0]], "once": [zlib.compress(once.tobytes(), 1)], "twice": [zlib.compress(twice.tobytes(), 1)]})

    parts = docs.select("text").mapInArrow(fill, "segment long, once binary, twice binary")
    tasks = docs.select("text").rdd.getNumPartitions()
    if tasks > MERGED:  # a first merge among parts of the tasks keeps every group small
        some = F.pmod(F.spark_partition_id(), F.lit(math.isqrt(tasks)))
        parts = parts.groupBy("segment", some.alias("part")).applyInPandas(merge, "segment long, once binary, twice binary")
    merged = parts.groupBy("segment").applyInPandas(merge, "segment long, once binary, twice binary").select("segment", "twice")
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        at = row.segment * (SEGMENT // 8)
        out[at : at + SEGMENT // 8] = np.frombuffer(zlib.decompress(bytes(row.twice)), np.uint8)
    return out


def _suspects(docs: DataFrame, bloom, min_chars: int) -> DataFrame:
    """(doc_id, key): one row for each row of `docs` (doc_id, text) and suspected key of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            found = [(row, k) for row, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True) for k in dict.fromkeys(key_digests(text, min_chars)) if k]
            if found:
                ids, keys = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"]).filter(pa.array(_test(bloom.value, list(keys))))

    return docs.mapInArrow(run, "doc_id long, key binary")


def filter_bits(docs: DataFrame) -> int:
    """A power of two that fits the table's lines, within the bounds."""
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 1
    return min(MAX_BITS, max(MIN_BITS, 1 << math.ceil(math.log2(lines * BITS_PER_KEY))))


def repeated_keys(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, groups: DataFrame | None = None) -> DataFrame:
    """(key, n): exact row counts of the keys found in at least `min_docs` rows (two or more).

    With `groups` (doc_id, group; doc_id unique) the rows of a group count as one, as do rows of one doc_id or of none.
    """
    spark = docs.sparkSession
    bloom = spark.sparkContext.broadcast(seen_twice(docs, filter_bits(docs), min_chars))
    ids = F.lit(None).cast("long") if groups is None else F.col("doc_id").cast("long")
    found = _suspects(docs.select(ids.alias("doc_id"), "text"), bloom, min_chars)
    if groups is not None:
        found = found.join(groups, "doc_id", "left").select("key", F.coalesce("group", "doc_id").alias("group")).distinct()
    counts = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= max(2, min_docs))


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, broadcast_keys: int = BROADCAST_KEYS, keep_first: bool = False, groups: DataFrame | None = None, spare_whole: bool = False) -> DataFrame:
    """`docs` with repeated lines removed from text, and n_lines, n_dropped, kept_sha256 added.

    keep_first leaves each key its first occurrence: the first line with it in the row of the smallest doc_id (equal
    doc_ids all keep theirs). `groups` is that of repeated_keys(). spare_whole leaves a text as it is if nothing but
    white space would remain. Columns of `docs` named n_lines, n_dropped or kept_sha256 give way to the new ones.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    docs, restore = sheltered(docs, ("doc_id", "text"))
    keys = settle(repeated_keys(docs, min_docs, min_chars, groups), "line-keys")
    first = _first_rows(docs, keys, min_chars) if keep_first else None
    if first is None and keys.limit(broadcast_keys + 1).count() <= broadcast_keys:
        gone = spark.sparkContext.broadcast(frozenset(bytes(r.key) for r in keys.select("key").toLocalIterator()))
        out = _rewrite(docs, lambda batch, names: [gone.value] * batch.num_rows, min_chars, spare_whole)
    else:
        out = _by_join(docs, keys, first, min_chars, spare_whole)
    return restore(out, "n_lines", "n_dropped", "kept_sha256")


def _first_rows(docs: DataFrame, keys: DataFrame, min_chars: int) -> DataFrame:
    """(key, doc_id): the row that keeps the key."""
    return _lines(docs.select(F.col("doc_id").alias("row"), "text"), min_chars).join(keys.select("key"), "key").groupBy("key").agg(F.min("row").alias("owner"))


def _lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """(row, key) for each distinct key of each row (row long, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            out = [(row, k) for row, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True) for k in dict.fromkeys(key_digests(text, min_chars)) if k]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["row", "key"])

    return rows.mapInArrow(run, "row long, key binary")


def _by_join(docs: DataFrame, keys: DataFrame, first: DataFrame | None, min_chars: int, spare_whole: bool = False) -> DataFrame:
    """The way beyond the broadcast bound: each row gets the list of its keys that go (and of those it keeps once)."""
    table = settle(docs.withColumn("_row", F.monotonically_increasing_id()), "lines")
    hits = lookup_join(_lines(table.select("_row", "text"), min_chars), keys.select("key", F.lit(True).alias("hit")), "key", max_rows=0, salt=F.col("row"))
    held = hits.filter("hit").select("key", F.col("row").alias("_row"))
    if first is not None:
        own = table.select("_row", "doc_id").join(held, "_row").join(first, "key").withColumn("mine", F.coalesce(F.col("doc_id") == F.col("owner"), F.lit(False)))
        lists = own.groupBy("_row").agg(F.collect_list("key").alias("_gone"), F.collect_list(F.when(F.col("mine"), F.col("key"))).alias("_once"))
    else:
        lists = held.groupBy("_row").agg(F.collect_list("key").alias("_gone")).withColumn("_once", F.lit(None).cast("array<binary>"))
    joined = table.join(lists, "_row", "left").drop("_row")

    def sets(batch: pa.RecordBatch, names: list[str]) -> list:
        gone, once = (batch.column(names.index(c)).to_pylist() for c in ("_gone", "_once"))
        return [(frozenset(g or ()), set(o or ())) for g, o in zip(gone, once, strict=True)]

    return _rewrite(joined, sets, min_chars, spare_whole)


def _rewrite(docs: DataFrame, sets, min_chars: int, spare_whole: bool = False) -> DataFrame:
    names = docs.columns
    kept_names = [c for c in names if c not in ("_gone", "_once", "n_lines", "n_dropped", "kept_sha256")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept_names)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            texts, lines, dropped, shas = [], [], [], []
            valid = batch.column(at).is_valid().to_pylist()
            for text, present, gone in zip(text_bytes(batch.column(at)), valid, sets(batch, names), strict=True):
                gone, once = gone if isinstance(gone, tuple) else (gone, None)
                parts = text.split(b"\n")
                keep = []
                for line, key in zip(parts, key_digests(text, min_chars), strict=True):
                    if key in gone:
                        if not once or key not in once:
                            continue
                        once.discard(key)
                    keep.append(line)
                if spare_whole and not b"".join(keep).strip(ASCII_SPACE):
                    keep = parts
                new = b"\n".join(keep)
                texts.append(new.decode() if present else None)
                lines.append(len(parts)), dropped.append(len(parts) - len(keep))
                shas.append(hashlib.sha256(new).hexdigest())
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(names.index(c)) for c in kept_names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(shas, pa.string())], [*kept_names, "n_lines", "n_dropped", "kept_sha256"])

    return docs.mapInArrow(run, f"{fields}, n_lines long, n_dropped long, kept_sha256 string")
