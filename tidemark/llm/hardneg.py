"""Hard negatives of a set of vectors by product quantisation with stored residual norms.

Every row is stored as one byte for each pair of components (its nearest centroid) and the length of what the centroid leaves
over. Sums of table look-ups give a score whose error cannot exceed the sum, over the pairs, of anchor length times residual
length, so rows whose interval misses what is wanted are left out without loss; the rest are scored exactly in integers.
The codebooks come from at most SAMPLE rows (those with the smallest hashes); they decide speed only, never results.

A row takes part if its label and vector are not null and all components are finite numbers. Vectors of different lengths
count as padded with zeros, an empty one as all zeros. Rows with a null vec_id can be partners, after all others of the same
score, and are never anchors. Repeated rows are rows of their own, a vec_id that repeats included: each is an anchor, and the
other rows of its id are "other rows". An empty table gives an empty result. Other columns are ignored. A score that no
64-bit integer holds is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Rows that the codebooks are trained on, centroids of a codebook, rounds of training.
SAMPLE, CENTROIDS, ROUNDS = 4096, 256, 6
#: At most so many rows and anchors meet in one task; their product is a task's work.
ROWS, ANCHORS = 1 << 16, 1 << 14
#: Rows and anchors whose scores are held at once.
ROW_STEP, ANCHOR_STEP = 2048, 256
_LAST = (1 << 63) - 1


def prepare(rows: DataFrame, label: Column) -> DataFrame:
    """row, vec_id, label, v of the rows that take part, each component x as floor(256 * x)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    times = lambda x: F.lit(256.0) * x.cast("double")
    scaled = F.transform("embedding", lambda x: F.when(F.abs(times(x)) < 2.0**52, F.floor(times(x)).cast("double")).otherwise(times(x)))  # beyond 2^52 all doubles are whole
    found = rows.select("vec_id", "embedding", label.cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    return found.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), "label", scaled.alias("v"))


def train(sample: np.ndarray) -> np.ndarray:
    """(pairs, CENTROIDS, 2): Lloyd's algorithm on each pair of components, begun at spread-out sample values."""
    books = []
    for part in sample.reshape(len(sample), -1, 2).transpose(1, 0, 2):
        known = np.unique(part, axis=0)
        book = np.resize(known[np.random.default_rng(7).permutation(len(known))], (CENTROIDS, 2)).astype(float)
        for _ in range(ROUNDS):
            near = assign(part, book)
            n = np.bincount(near, minlength=CENTROIDS)
            sums = np.stack([np.bincount(near, part[:, k], CENTROIDS) for k in (0, 1)], 1)
            book[n > 0] = sums[n > 0] / n[n > 0, None]
        books.append(book)
    return np.stack(books)


def assign(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid of each row of `part` (n, 2)."""
    return np.argmin((book * book).sum(1) - 2 * part @ book.T, axis=1)


def _encode(books: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 4096):
                batch = whole.slice(at, 4096)
                v = np.zeros((len(batch), width))
                lists = batch.column("v")
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(batch)), sizes)
                v[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
                codes, rest = np.empty((len(v), len(books)), np.uint8), np.empty((len(v), len(books)), np.float32)
                for m, book in enumerate(books):
                    part = v[:, 2 * m : 2 * m + 2]
                    codes[:, m] = near = assign(part, book)
                    rest[:, m] = np.nextafter(np.sqrt(((part - book[near]) ** 2).sum(1)).astype(np.float32), np.float32(np.inf))
                packed = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (v, codes, rest)]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), batch.column("label"), *packed], ["row", "vec_id", "label", "v", "codes", "rest"])

    return run


def _matrix(column, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


class _Cell:
    """The rows of one cell, and the scores of anchors with them: bounds from look-ups, exact ones from the vectors."""

    def __init__(self, rows: pa.Table, anchors: pa.Table, books: np.ndarray):
        self.books, n = books, len(books)
        order = np.argsort(rows.column("label").to_numpy(), kind="stable")  # rows of one label lie together
        rows = rows.take(pa.array(order))
        self.row, self.label = rows.column("row").to_numpy(), rows.column("label").to_numpy()
        self.id = _ids(rows)
        self.v, self.codes, self.rest = _matrix(rows.column("v"), np.float64, 2 * n), _matrix(rows.column("codes"), np.uint8, n), _matrix(rows.column("rest"), np.float32, n)
        self.a, self.a_row, self.a_label = _matrix(anchors.column("v"), np.float64, 2 * n), anchors.column("row").to_numpy(), anchors.column("label").to_numpy()
        most = np.abs(self.v).max(initial=0) * np.abs(self.a).max(initial=0) * max(1, 2 * n)
        self.exact_in_float = most < 2**53

    def tables(self, some: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Look-up tables of these anchors, their lengths by pair, and a margin for the rounding of 32-bit sums."""
        parts = self.a[some].reshape(len(some), -1, 2)
        lengths = np.sqrt((parts**2).sum(2)).T
        margin = 1e-5 * (lengths * np.sqrt((self.books**2).sum(2)).max(1)[:, None]).sum(0) + 1e-3
        return [(book @ parts[:, m].T).astype(np.float32) for m, book in enumerate(self.books)], lengths.astype(np.float32) * np.float32(1.00001), margin.astype(np.float32)

    def bounds(self, part: slice, tables) -> tuple[np.ndarray, np.ndarray]:
        """(rows, anchors) bounds below and above the scores."""
        look, lengths, margin = tables
        codes = self.codes[part]
        total = look[0].take(codes[:, 0], axis=0) if look else np.zeros((len(codes), len(margin)), np.float32)
        for m in range(1, len(look)):
            total += look[m].take(codes[:, m], axis=0)
        error = self.rest[part] @ lengths * np.float32(1.0001) + margin
        return total - error, total + error

    def exact(self, part: slice, some: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers, anchor places and integer scores of the pairs in `mask`."""
        rows = np.flatnonzero(mask.any(axis=1))
        r, b = np.nonzero(mask[rows])
        v, a = self.v[part][rows], self.a[some]
        if self.exact_in_float:
            score = (v @ a.T)[r, b].astype(np.int64)
        else:
            score = [sum(int(x) * int(y) for x, y in zip(v[i], a[j], strict=True)) for i, j in zip(r, b, strict=True)]
            if any(abs(s) > _LAST for s in score):
                raise OverflowError("a score exceeds 64 bits")
            score = np.array(score, np.int64)
        return rows[r] + part.start, b, score


def _ids(table: pa.Table) -> np.ndarray:
    """vec_id with nulls last in order."""
    return table.column("vec_id").fill_null(_LAST).to_numpy()


def _best(slot: np.ndarray, score: np.ndarray, at: np.ndarray, cell: _Cell, slots: int, limit: int):
    """The first `limit` of each slot by score, vec_id and row; and each slot's last score if it is full, else -inf."""
    order = np.lexsort((cell.row[at], cell.id[at], -score, slot))
    slot, score, at = slot[order], score[order], at[order]
    place = np.arange(len(slot)) - np.searchsorted(slot, slot)
    slot, score, at, place = (x[place < limit] for x in (slot, score, at, place))
    last = np.full(slots, -np.inf)
    last[slot[place == limit - 1]] = score[place == limit - 1]
    return slot, score, at, last


def _cell_positives(books: np.ndarray, limit: int):
    def run(key, rows, anchors):
        kept = []
        if len(rows) and len(anchors):
            cell = _Cell(rows, anchors, books)
            for label in np.unique(cell.a_label):
                low, high = np.searchsorted(cell.label, [label, label], "left")[0], np.searchsorted(cell.label, label, "right")
                own = np.flatnonzero(cell.a_label == label)
                for first in range(0, len(own) if high > low else 0, ANCHOR_STEP):
                    some = own[first : first + ANCHOR_STEP]
                    tables, last = cell.tables(some), np.full(len(some), -np.inf)
                    slot, score, at = np.empty(0, int), np.empty(0, np.int64), np.empty(0, int)
                    for begin in range(low, high, ROW_STEP):
                        part = slice(begin, min(begin + ROW_STEP, high))
                        below, above = cell.bounds(part, tables)
                        if begin == low and len(below) > limit + 1:  # one more than wanted: the anchor itself may be among them
                            last = np.partition(below, -limit - 1, axis=0)[-limit - 1].astype(float)
                        mask = (above >= last) & (cell.row[part][:, None] != cell.a_row[some])
                        r, b, s = cell.exact(part, some, mask)
                        slot, score, at, full = _best(np.append(slot, b), np.append(score, s), np.append(at, r), cell, len(some), limit)
                        last = np.maximum(last, full)
                    kept.append((cell.a_row[some][slot], cell.row[at], cell.id[at], score))
        a, r, i, s = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (list(zip(*kept, strict=True)) or [[]] * 4))
        return pa.table({"anchor": pa.array(a, pa.int64()), "row": pa.array(r, pa.int64()), "vec_id": pa.array(i, pa.int64(), mask=i == _LAST), "score": pa.array(s, pa.int64())})

    return run


def _cell_negatives(books: np.ndarray, limit: int, share: tuple[int, int]):
    def run(key, rows, anchors):
        kept = []
        if len(rows) and len(anchors):
            cell = _Cell(rows, anchors, books)
            wanted = anchors.column("scores").to_pylist()
            most = max(map(len, wanted))
            for first in range(0, len(wanted), ANCHOR_STEP):
                some = np.arange(first, min(first + ANCHOR_STEP, len(wanted)))
                slots = len(some) * most
                low, high = np.full(slots, np.inf), np.full(slots, -np.inf)
                for b, k, s in ((b, k, s) for b, a in enumerate(some) for k, s in enumerate(wanted[a])):
                    low[b * most + k], high[b * most + k] = -(-share[0] * s // 100), share[1] * s // 100
                tables, last = cell.tables(some), np.full(slots, -np.inf)
                slot, score, at = np.empty(0, int), np.empty(0, np.int64), np.empty(0, int)
                for begin in range(0, len(cell.row), ROW_STEP):
                    part = slice(begin, min(begin + ROW_STEP, len(cell.row)))
                    below, above = cell.bounds(part, tables)
                    other = cell.label[part][:, None] != cell.a_label[some]
                    mask = np.zeros(other.shape, bool)
                    for k in range(most):
                        lo, hi = low[k::most], high[k::most]
                        if not begin and len(below) > limit:  # rows surely inside give a first threshold
                            sure = np.where(other & (below >= lo) & (above <= hi), below, np.float32(-np.inf))
                            last[k::most] = np.partition(sure, -limit, axis=0)[-limit]
                        mask |= (above >= np.maximum(lo, last[k::most])) & (below <= hi)
                    r, b, s = cell.exact(part, some, mask & other)
                    for k in range(most):
                        place = b * most + k
                        inside = (s >= low[place]) & (s <= high[place]) & (s >= last[place])
                        slot, score, at = np.append(slot, place[inside]), np.append(score, s[inside]), np.append(at, r[inside])
                    slot, score, at, full = _best(slot, score, at, cell, slots, limit)
                    last = np.maximum(last, full)
                kept.append((cell.a_row[some[slot // most]], slot % most, cell.row[at], cell.id[at], score))
        a, k, r, i, s = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (list(zip(*kept, strict=True)) or [[]] * 5))
        return pa.table({"anchor": pa.array(a, pa.int64()), "k": pa.array(k, pa.int32()), "row": pa.array(r, pa.int64()), "vec_id": pa.array(i, pa.int64(), mask=i == _LAST), "score": pa.array(s, pa.int64())})

    return run


def _first(df: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The first `limit` rows of each group, numbered from 1; cells send no more than that many each."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def mine(rows: DataFrame, label: Column, anchor: Column, positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `label` is the label to use, `anchor` says which rows are anchors. Anchors meet all rows in cells of bounded size: rows
    and anchors are each dealt into groups by a hash, and every pair of groups is one cell.
    """
    spark = rows.sparkSession
    ready = settle(prepare(rows.withColumn("label", label).select("vec_id", "embedding", "label"), F.col("label")), "vectors")
    extent = ready.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.count(F.when(anchor, 1)).alias("anchors")).first()
    width = 2 * -(-(extent["width"] or 0) // 2)
    sample = [r["v"] for r in ready.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()]
    grid = np.zeros((len(sample), width))
    for at, v in enumerate(sample):
        grid[at, : len(v)] = v
    books = train(grid) if len(sample) and width else np.zeros((0, CENTROIDS, 2))
    coded = settle(ready.mapInArrow(_encode(books, width), "row long, vec_id long, label int, v binary, codes binary, rest binary"), "codes")
    lanes = spark.sparkContext.defaultParallelism
    row_groups = max(1, -(-extent["n"] // ROWS), min(2 * lanes, -(-extent["n"] // 1024)))
    anchor_groups = max(1, -(-extent["anchors"] // ANCHORS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  both sides come from one table
    cells = coded.withColumn("j", F.pmod(F.xxhash64("row"), F.lit(row_groups)).cast("int")).withColumn("i", every(anchor_groups)).groupBy("i", "j")
    anchors = fresh(coded.filter(anchor).select("row", "vec_id", "label", "v")).withColumn("i", F.pmod(F.xxhash64("row"), F.lit(anchor_groups)).cast("int"))

    near = cells.cogroup(fresh(anchors.withColumn("j", every(row_groups))).groupBy("i", "j"))
    near = near.applyInArrow(_cell_positives(books, positives), "anchor long, row long, vec_id long, score long")
    near = settle(_first(near, ["anchor"], positives).select("anchor", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = near.groupBy(F.col("anchor").alias("row")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    asking = fresh(anchors.join(scores, "row").withColumn("j", every(row_groups))).groupBy("i", "j")
    far = cells.cogroup(asking).applyInArrow(_cell_negatives(books, negatives, share), "anchor long, k int, row long, vec_id long, score long")
    far = _first(far, ["anchor", "k"], negatives).select("anchor", (F.col("k") + 1).alias("nth"), F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = far.join(near.withColumnRenamed("rank", "nth"), ["anchor", "nth"]).join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def contract_label() -> Column:
    """(label + 1) % 10 where vec_id is divisible by 7, else label."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
