"""From raw documents to packed training sequences: the stages in order, each written as Parquet and read again by the next.

Every stage but the last returns the columns of `documents`; rows leave only by a stage's own decision. Null and empty texts
have no language and go in the first stage. Rows with a null doc_id, repeated rows and repeated doc_ids are carried along: rows
that share a doc_id are one document, whose group of near copies they join together. An empty table gives an empty result.
Long texts pass whole. Extra columns stay as they are, whatever their names; only n_chars follows a changed text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import settle, shared_path, sheltered
from tidemark.llm.langid import identify
from tidemark.llm.linededup import drop_repeated_lines
from tidemark.llm.neardup import near_duplicates
from tidemark.llm.packing import pack, token_pieces
from tidemark.llm.pii import sanitise

#: A document stays if its language's posterior reaches this; `und` never does.
LEAST_LANGUAGE_SCORE = 0.5
#: Texts are near copies from this Jaccard similarity of their word shingles on.
COPY_PERCENT = 80


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows a text that a stage may have changed."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else docs


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or with no clear language, go."""
    third = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    narrow, restore = sheltered(docs, ("doc_id", "text", "lang"))
    found = identify(narrow, train=third != 1)
    return restore(found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go, near copies counting as one; every document stays.

    So the lines of a text with many copies stay for the next stage, as does a text made of nothing but such lines.
    """
    copies = near_duplicates(docs, percent=COPY_PERCENT).groupBy("doc_id").agg(F.min("component_id").alias("group")).filter(F.col("group") != F.col("doc_id"))
    narrow, restore = sheltered(docs, ("doc_id", "text"))
    return _measured(restore(drop_repeated_lines(narrow, groups=settle(copies, "copies"), spare_whole=True)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    copies = near_duplicates(docs, percent=COPY_PERCENT).filter("not kept").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms are masked; every document stays."""
    return _measured(sanitise(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return pack(token_pieces(docs))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: No SQL: segmentation sums, token ids and packing are beyond it; tests compare the stages' rows with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result goes to the shared folder and comes back as the next stage's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
