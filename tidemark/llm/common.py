"""Helpers that the corpus operators share: shared storage, Arrow batches, guarded broadcasts."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, what `[\x20\x09-\x0D]` matches; bytes.split() and bytes.strip() use the same set.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share. Only where the cluster names none (as in tests) one under /tmp is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext.getCheckpointDir()
        if known:
            return known
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file:///tmp/tidemark-checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    It cuts the lineage, fixes values such as row ids for good, and survives the loss of executors.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_settled(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove tables written by settle() that no later step reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for df in frames:
        for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Have the driver collect its finished plans: only then are their shuffle files removed, else at the next of its half-hourly turns.

    Python lets go of the driver's objects in a thread of its own, and so does the cleaner its work: both get time.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.5)
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def sheltered(docs: DataFrame, needed: tuple[str, ...]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """`docs` with the columns not needed under names that no step uses, and a function that gives them their names back.

    The function returns the columns of `docs` in their order, then the extra ones it is told; an extra column takes the
    place of one of `docs` with its name.
    """
    own = {c: c if c in needed else f"kept{i}__" for i, c in enumerate(docs.columns)}

    def restore(df: DataFrame, *extra: str) -> DataFrame:
        return df.select(*[F.col(own[c]).alias(c) for c in docs.columns if c not in extra], *extra)

    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()]), restore


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


#: Rows of a batch whose texts are Python objects at one time.
ROWS = 1000


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows, without copies: what a task makes of a batch is as small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with a function from one batch, of ROWS rows at most, to one batch (or None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            out = fn(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


class Memo(dict):
    """A dict that fills itself by `make`. At `limit` entries it becomes the old generation, from which used ones return.

    Keys over `longest` are made anew each time, so that memory stays bounded.
    """

    def __init__(self, make, limit: int, longest: int | None = None):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        if self.longest and len(key) > self.longest:
            return self.make(key)
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def lookup_join(left: DataFrame, small: DataFrame, key: str, max_rows: int = 100_000, salt: Column | None = None, salts: int = 64) -> DataFrame:
    """Left join on `key`, unique in `small` and possibly hot in `left`.

    `small` is broadcast only after its rows have been counted and found to be at most `max_rows`; beyond, the rows
    of `left` are salted and `small` is repeated once for each salt, so no hot key lands in one task.
    """
    if small.limit(max_rows + 1).count() <= max_rows:
        return left.join(F.broadcast(small), key, "left")
    chosen = F.pmod(F.xxhash64(salt if salt is not None else F.rand(7)), F.lit(salts)).cast("int")
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", chosen).join(spread, [key, "_salt"], "left").drop("_salt")
