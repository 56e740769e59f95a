"""The registered queries on the smallest tables: columns, whole tables, and the SQL of those that have it."""

import zlib

import duckdb
import pytest

from tidemark.llm import queries as Q

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["doc_id", "n_shingles", "component_id", "kept"],
    "op2": ["doc_id", "held_out", "lang_pred", "score"],
    "op3": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op4": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op5": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "bins", "bound"],
    "op6": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"],
    "op7": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op8": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op9": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op10": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op11": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
    "op12": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    "op13": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
}


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, name):
    table = {"op4": "pages", "op11": "embeddings"}.get(name.split("_")[0], "documents")
    rows = spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    out = Q.QUERIES[name](spark, FOLDER)
    assert set(COLUMNS[name.split("_")[0]]) <= set(out.columns)
    found = out.toPandas()
    if name.startswith("op5"):
        assert found.doc_id.nunique() == rows and (found.bins >= found.bound).all()
        assert found.groupby("sequence_id").length.sum().max() <= 1024
    elif name.startswith("op11"):
        assert set(found.anchor_id) <= set(range(0, 10**6, 50)) and found["rank"].between(1, 3).all()
    else:
        assert len(found) == rows
    if name.startswith("op2"):
        assert (found.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in found.doc_id]).all()
    if name.startswith("op10"):
        assert set(found["law"]) == {"bytes"} and found.grown_shard.isna().all() and found.shard.between(0, 7).all()
    if name in Q.SQL:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
        want = con.execute(Q.SQL[name]).df()
        key = [c for c in COLUMNS[name.split("_")[0]] if c != "negative_score"]
        assert set(want.columns) == set(found.columns)
        a, b = (x[sorted(x.columns)].sort_values(key).reset_index(drop=True) for x in (found, want))
        for c in a.columns:
            assert (a[c].isna() == b[c].isna()).all() and (a[c].fillna(0) == b[c].fillna(0)).all(), c


def test_op4_and_op7_and_op9_have_sql():
    assert {"op4_warc_normaliser", "op7_host_quality", "op9_line_dedup"} <= set(Q.SQL)
