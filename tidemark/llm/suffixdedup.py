"""Exact removal of byte strings that an earlier document holds, by suffix arrays over anchored pieces.

A byte goes if a string of SPAN bytes that covers it also starts, at any place, in a document with a smaller doc_id. Every such
window has an anchor, the smallest hash among its GRAM-byte strings, so equal windows have equal anchors. Windows in a row with
one anchor form a piece. Two Bloom filters, of anchors seen and of anchors seen again, let pass the pieces whose anchor may
occur in several rows; false positives cost shuffle and change nothing. Places of equal pieces settle by their smallest doc_id
alone. Only where different pieces share an anchor do their bytes leave the scan: many such buckets at a time are sorted by one
suffix array (`grouping.py`), whose neighbours that agree in SPAN bytes show the windows that a smaller document has too.
Buckets of more than BUCKET different pieces, such as those at the edge of a line found everywhere, are dealt anew by whole
windows, each of which is a bucket with one text.

Null texts count as empty; texts under SPAN bytes lose nothing. Documents with equal doc_ids take nothing from each other, and
rows with a null doc_id neither lose nor take anything. Repeated rows get one result each. Long texts take memory in
proportion. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_settled, in_parts, release_shuffles, settle, text_bytes
from .grouping import suffix_array

SPAN, GRAM = 50, 20
#: A piece has at most so many windows, so constant texts make short pieces too.
LONGEST = 4096
#: Different pieces of one anchor that a suffix array takes, and pieces that one takes on average.
BUCKET, TOGETHER = 20_000, 4096
#: Bytes of text hashed at once; bits of a filter and of the segments it travels in. A filter has a bit for each byte of text.
CHUNK = 1 << 18
MIN_BITS, MAX_BITS, SEGMENT = 1 << 20, 1 << 29, 1 << 19


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def anchored(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document number, first and end byte, and anchor of each piece of these texts."""
    lengths = np.array([len(t) for t in texts], np.int64)
    whole = np.frombuffer(b"".join(texts), np.uint8)
    if len(whole) < SPAN:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    by = {k: np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in (1, 2, 4, 8)}
    h = {1: whole.astype(np.uint64) + np.uint64(1)}
    for k in (1, 2, 4, 8):
        h[2 * k] = h[k][:-k] * by[k] + h[k][k:]
    grams = _mixed(h[16][: len(whole) - GRAM + 1] * by[4] + h[4][16:])  # 20 bytes: 16 and 4
    least, width = grams, 1
    while width * 2 <= SPAN - GRAM + 1:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    rest = SPAN - GRAM + 1 - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    owner = np.repeat(np.arange(len(texts)), lengths)
    inside = owner[: len(least)] == owner[SPAN - 1 :]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]) | (owner[1 : len(least)] != owner[: len(least) - 1])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(least))
    if (ends - starts).max() > LONGEST:
        parts = -(-(ends - starts) // LONGEST)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, ends = np.repeat(starts, parts) + nth * LONGEST, np.repeat(ends, parts)
        ends = np.minimum(starts + LONGEST, ends)
    kept = inside[starts]
    starts, ends = starts[kept], ends[kept]
    doc = owner[starts]
    base = (np.cumsum(lengths) - lengths)[doc]
    return doc, starts - base, ends - base + SPAN - 1, least[starts]


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in lists of about CHUNK bytes, with the number of each list's first text."""
    first, size = 0, 0
    for at, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK:
            yield first, texts[first : at + 1]
            first, size = at + 1, 0
    yield first, texts[first:]


def _bits(anchors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (anchors & np.uint64(bits - 1)).astype(np.int64), ((anchors >> np.uint64(33)) & np.uint64(bits - 1)).astype(np.int64)


def _has(bloom: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = at
    return ((bloom[a >> 3] >> (a & 7).astype(np.uint8)) & (bloom[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def _put(bloom: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> None:
    for x in at:
        np.bitwise_or.at(bloom, x >> 3, np.left_shift(np.uint8(1), (x & 7).astype(np.uint8)))


SHAPE = "segment long, once binary, again binary"


def _segments(once: np.ndarray, again: np.ndarray) -> Iterator[pa.RecordBatch]:
    size = min(SEGMENT // 8, len(once))
    for at in range(len(once) // size):
        a, b = (x[at * size : (at + 1) * size] for x in (once, again))
        if a.any() or b.any():
            yield pa.RecordBatch.from_pydict({"segment": [at], "once": [zlib.compress(a.tobytes(), 1)], "again": [zlib.compress(b.tobytes(), 1)]})


def _united(parts: DataFrame, tasks: int, bits: int) -> np.ndarray:
    """The filters of tasks as one: set in one of them, or seen once by two. Segments merge in two steps if there are many."""

    size = min(SEGMENT, bits) // 8

    def merge(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        once, again = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for a, b in zip(frame.once, frame.again, strict=True):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            again |= b | (once & a)
            once |= a
        return pd.DataFrame({"segment": [keys[0]], "once": [zlib.compress(once.tobytes(), 1)], "again": [zlib.compress(again.tobytes(), 1)]})

    if tasks > 256:
        parts = parts.groupBy("segment", F.pmod(F.spark_partition_id(), F.lit(int(tasks**0.5))).alias("part")).applyInPandas(merge, SHAPE)
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.groupBy("segment").applyInPandas(merge, SHAPE).select("segment", "again").toLocalIterator():
        out[row.segment * size : (row.segment + 1) * size] = np.frombuffer(zlib.decompress(bytes(row.again)), np.uint8)
    return out


def _bits_for(keys: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << int(keys).bit_length()))


def seen_again(docs: DataFrame, bits: int) -> np.ndarray:
    """The filter of anchors that several rows may hold."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in in_parts(batches):
            for _, texts in _chunks(text_bytes(batch.column("text"))):
                doc, _, _, anchor = anchored(texts)
                order = np.argsort(anchor, kind="stable")  # texts stay in order within an anchor
                doc, anchor = doc[order], anchor[order]
                same = anchor[1:] == anchor[:-1]
                own = _bits(anchor[np.append(True, ~same)] if len(anchor) else anchor, bits)
                known = _has(once, own)
                _put(again, tuple(x[known] for x in own))
                _put(again, _bits(anchor[1:][same & (doc[1:] != doc[:-1])], bits))
                _put(once, own)
        yield from _segments(once, again)

    return _united(docs.select("text").mapInArrow(fill, SHAPE), docs.rdd.getNumPartitions(), bits)


def _filter_of(anchors: DataFrame, bits: int) -> np.ndarray:
    """A filter of these anchors."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            _put(own, _bits(batch.column("anchor").to_numpy().view(np.uint64), bits))
        yield from _segments(np.zeros_like(own), own)

    return _united(anchors.select("anchor").mapInArrow(fill, SHAPE), anchors.rdd.getNumPartitions(), bits)


def _pieces(docs: DataFrame, bloom, contents: bool) -> DataFrame:
    """Pieces of `docs` (doc_id, digest, text) whose anchors the filter lets pass: their places, or each one's bytes once for
    a batch. Anchor and hash together name a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = len(bloom.value) * 8
        for batch in in_parts(batches):
            ids, digests = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("digest").to_numpy(zero_copy_only=False)
            for begin, texts in _chunks(text_bytes(batch.column("text"))):
                doc, start, end, anchor = anchored(texts)
                passed = np.flatnonzero(_has(bloom.value, _bits(anchor, bits)))
                doc, start, end, anchor = doc[passed], start[passed], end[passed], anchor[passed].view(np.int64)
                cut = [texts[d][s:e] for d, s, e in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True)]
                keys = np.array([xxhash.xxh3_64_intdigest(x) for x in cut], np.uint64).view(np.int64)
                if contents:
                    _, first = np.unique(keys, return_index=True)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[first]), pa.array(keys[first]), pa.array([cut[k] for k in first], pa.binary())], ["anchor", "piece", "content"])
                else:
                    doc = doc + begin
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(keys), pa.array(ids[doc], pa.int64()), pa.array(digests[doc], pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["anchor", "piece", "doc_id", "digest", "first", "last"])

    return docs.mapInArrow(run, "anchor long, piece long, content binary" if contents else "anchor long, piece long, doc_id long, digest long, first int, last int")


def _passed(pieces: DataFrame, bloom) -> DataFrame:
    """The rows whose anchors the filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_has(bloom.value, _bits(batch.column("anchor").to_numpy().view(np.uint64), len(bloom.value) * 8))))

    return pieces.mapInArrow(run, pieces.schema)


def _merged(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes covered by windows of that length at these ascending starts."""
    new = np.append(True, starts[1:] > starts[:-1] + length)
    begin = np.flatnonzero(new)
    return starts[begin], starts[np.append(begin[1:], len(starts)) - 1] + length


def repeats(contents: list[bytes], low: np.ndarray) -> list[tuple[int, int, int]]:
    """(content, first, end): bytes of each content in windows that a content of a smaller document also has.

    The suffix array of all contents, each ended by a lowest symbol, brings equal windows together.
    """
    owner = np.repeat(np.arange(len(contents)), [len(c) + 1 for c in contents])
    offset = np.concatenate([np.arange(len(c) + 1) for c in contents])
    symbols = np.concatenate([np.append(np.frombuffer(c, np.uint8).astype(np.int16) + 1, np.int16(0)) for c in contents])
    order = np.array(suffix_array(symbols.tolist()), np.int64)
    left = np.array([len(c) for c in contents])[owner] - offset
    order = order[left[order] >= SPAN]
    rows = np.lib.stride_tricks.sliding_window_view(symbols, SPAN)[order]
    group = np.cumsum(np.append(True, (rows[1:] != rows[:-1]).any(axis=1))) - 1
    least = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, low[owner[order]])
    hit = np.sort(order[low[owner[order]] > least[group]])
    out = []
    for c in np.unique(owner[hit]):
        first, end = _merged(offset[hit[owner[hit] == c]], SPAN)
        out += [(int(c), int(a), int(b)) for a, b in zip(first, end, strict=True)]
    return out


def _shared_parts(contents: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(content, first, end): maximal parts of each content whose windows another content may have; the rest needs no sorting."""
    windows = [[hash(c[i : i + SPAN]) for i in range(len(c) - SPAN + 1)] for c in contents]
    seen: set[int] = set()
    twice: set[int] = set()
    for w in map(set, windows):
        twice |= seen & w
        seen |= w
    for k, w in enumerate(windows):
        if twice.isdisjoint(w):
            continue
        begin = None
        for i, x in enumerate([*w, None]):
            if x is not None and x in twice:
                begin = i if begin is None else begin
            elif begin is not None:
                yield k, begin, i - 1 + SPAN
                begin = None


def _sort_buckets(key, table):
    """Spans of the pieces of many buckets. Equal parts of a bucket are one text; buckets with several texts go into suffix
    arrays of a few thousand bytes each, where windows of different anchors differ and do not disturb each other."""
    contents, low, anchor = (table.column(c).to_pylist() for c in ("content", "low", "anchor"))
    parts = list(_shared_parts(contents))
    buckets: dict[int, dict[bytes, int]] = {}
    for k, a, b in parts:
        least, text = buckets.setdefault(anchor[k], {}), contents[k][a:b]
        least[text] = min(low[k], least.get(text, low[k]))
    inside: dict[bytes, list] = {}  # a text has windows of one anchor only
    texts: list[bytes] = []
    lows: list[int] = []
    size = 0
    for least in [*(x for x in buckets.values() if len(x) > 1), None]:
        if texts and (least is None or size > 4096):
            for k, a, b in repeats(texts, np.array(lows)):
                inside.setdefault(texts[k], []).append((a, b))
            texts, lows, size = [], [], 0
        for text, first in (least or {}).items():
            texts.append(text)
            lows.append(first)
            size += len(text)
    found = []
    for k, a, b in parts:
        text = contents[k][a:b]
        found += [(k, a, b)] if low[k] > buckets[anchor[k]][text] else [(k, a + x, a + y) for x, y in inside.get(text, ())]
    at = pa.array([k for k, _, _ in found], pa.int64())
    return pa.table({"anchor": table.column("anchor").take(at), "piece": table.column("piece").take(at), "a": pa.array([a for _, a, _ in found], pa.int32()), "b": pa.array([b for _, _, b in found], pa.int32())})


def _by_windows(many: DataFrame) -> DataFrame:
    """The same spans for pieces of crowded buckets: each window is a key, taken with its smallest doc_id."""
    at = F.explode(F.sequence(F.lit(1), F.octet_length("content") - (SPAN - 1))).alias("at")
    windows = many.select("anchor", "piece", "low", "content", at).select("anchor", "piece", "low", (F.col("at") - 1).alias("a"), F.expr(f"substring(content, at, {SPAN})").alias("window"))
    least = windows.groupBy("window").agg(F.min("low").alias("least"), F.max("low").alias("most")).filter("least < most").drop("most")
    return windows.join(least, "window").filter("low > least").select("anchor", "piece", F.col("a").cast("int"), (F.col("a") + SPAN).cast("int").alias("b"))


def repeated_spans(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, digest, spans) of the documents (doc_id, digest, text) that lose bytes; spans may overlap."""
    spark = docs.sparkSession
    docs = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bloom = spark.sparkContext.broadcast(seen_again(docs, _bits_for(size)))
    places = settle(_pieces(docs, bloom, False), "places")
    bloom.destroy()  # each machine has a copy on its disk
    pieces = settle(places.groupBy("anchor", "piece").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")), "pieces")
    release_shuffles(spark)
    crowds = settle(pieces.groupBy("anchor").count().filter("count > 1"), "crowds")
    extent = crowds.agg(F.count("*").alias("anchors"), F.sum("count").alias("pieces")).first()
    known = spark.sparkContext.broadcast(_filter_of(crowds, _bits_for(16 * extent["anchors"])))
    contents = _pieces(docs, known, True).groupBy("anchor", "piece").agg(F.first("content").alias("content"))
    crowded = _passed(pieces.select("anchor", "piece", "low"), known).join(crowds, "anchor")  # few of all pieces, so bytes shuffle once
    contents = settle(contents.join(crowded, ["anchor", "piece"]).select("anchor", "piece", "content", "low", "count"), "contents")
    known.destroy()
    del crowded
    release_shuffles(spark)
    parts = max(1, -(-(extent["pieces"] or 0) // TOGETHER))
    small = contents.filter(F.col("count") <= bucket).groupBy(F.pmod(F.xxhash64("anchor"), F.lit(parts)).alias("part"))
    small = small.applyInArrow(_sort_buckets, "anchor long, piece long, a int, b int")
    inner = small.union(_by_windows(contents.filter(F.col("count") > bucket))).groupBy("anchor", "piece").agg(F.collect_list(F.struct("a", "b")).alias("inner"))
    useful = settle(pieces.join(inner, ["anchor", "piece"], "left").filter("low < high OR inner IS NOT NULL").drop("high"), "useful")
    drop_settled(spark, pieces, crowds, contents)
    del inner, small, pieces, crowds, contents
    release_shuffles(spark)
    whole = F.array(F.struct(F.col("first").alias("a"), F.col("last").alias("b")))
    part = F.transform("inner", lambda x: F.struct((F.col("first") + x["a"]).alias("a"), (F.col("first") + x["b"]).alias("b")))
    spans = places.join(useful, ["anchor", "piece"]).select("doc_id", "digest", F.explode(F.when(F.col("doc_id") > F.col("low"), whole).otherwise(part)).alias("span"))
    spans = settle(spans.groupBy("doc_id", "digest").agg(F.collect_set("span").alias("spans")), "spans")
    drop_settled(spark, places, useful)
    del places, useful
    release_shuffles(spark)
    return spans


def _without(text: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """The bytes outside the spans, how many lie inside, and in how many runs."""
    kept, end, gone, runs = [], 0, 0, 0
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if a > end or not runs:
            kept.append(text[end:a])
            runs, gone, end = runs + 1, gone + b - a, b
        elif b > end:
            gone, end = gone + b - end, b
    return b"".join([*kept, text[end:]]), gone, runs


def drop_repeats(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row, and `kept`, the bytes that stay (not always valid UTF-8)."""
    twice = docs.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").limit(1).count()
    digest = F.xxhash64("text") if twice else F.lit(0).cast("long")  # tells texts of one doc_id apart
    narrow = docs.select("doc_id", digest.alias("digest"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            texts = text_bytes(batch.column("text"))
            done = [_without(t, s or []) for t, s in zip(texts, batch.column("spans").to_pylist(), strict=True)]
            numbers = [pa.array(x, pa.int64()) for x in ([len(t) for t in texts], [g for _, g, _ in done], [r for _, _, r in done])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, pa.array([hashlib.sha256(k).hexdigest() for k, _, _ in done], pa.string()), pa.array([k for k, _, _ in done], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    found = narrow.join(repeated_spans(narrow, bucket), ["doc_id", "digest"], "left").select("doc_id", "text", "spans")
    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
