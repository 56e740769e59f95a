"""Document quality rules, and verdicts on hosts from shrunk failure rates.

Each document is measured and judged by two rules of its own (few words, repeated windows). Failures of these and of two
soft rules (symbols, repeated lines) are summed by host. A host's rate of each rule is shrunk towards all hosts' by an
empirical beta prior (fitted by moments, so a host with few documents says little), and the verdicts are joined back:

* where the shrunk rate of own failures exceeds `limit`, every document of the host is rejected;
* where the shrunk rate of a soft rule exceeds the prior's mean, the host is strict in it, and its documents that fail
  the rule are rejected. Other hosts' stay: alone, a table or a list is no reason.

Null and empty texts have no words and fail. Rows with a null host get no host verdict. Repeated rows count each by itself; a
host exactly at a limit passes; an empty table stays empty; long texts take memory in proportion. Other columns are ignored
and never returned, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash as M
from .common import ASCII_SPACE, Memo, lookup_join, map_batches, settle, text_bytes

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
_words: Memo = Memo(xxhash.xxh3_64_intdigest, 400_000, 64)


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one UTF-8 text."""
    words = text.split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0
    chars = int((np.frombuffer(b"".join(words), np.int8) >= -64).sum())  # all but continuation bytes
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(ASCII_SPACE)]
    repeat = 0
    if n > WINDOW:
        h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
        acc = h[: n - WINDOW + 1] * M._W[0]
        for i in range(1, WINDOW):
            acc += h[i : n - WINDOW + 1 + i] * M._W[i]
        _, inverse, counts = np.unique(M.mix(acc), return_inverse=True, return_counts=True)
        if counts.max() > 1:
            hit = np.flatnonzero(counts[inverse] > 1)
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + WINDOW, -1)
            repeat = int((np.cumsum(edge)[:n] > 0).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeat


def document_stats(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, the five counts, and base_failed."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([measure(t) for t in text_bytes(batch.column(2))], np.int64).reshape(-1, 5)
        failed = (rows[:, 0] < 10) | (100 * rows[:, 4] > 20 * rows[:, 0])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(rows[:, i]) for i in range(5)), pa.array(failed)], ["doc_id", "host", *COUNTS, "base_failed"])

    columns = docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), "text")
    return map_batches(columns, run, f"doc_id long, host string, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(alpha, beta) by the method of moments over the hosts' (n, failed), weighted by n; one row reaches the driver."""
    rate = F.col("failed") / F.col("n")
    x = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col("n") * rate * rate).alias("square"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not x.n:
        return 1.0, 1.0
    mean = x.failed / x.n
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    spread = x.square / x.n - mean * mean
    noise = mean * (1 - mean) * x.hosts / x.n  # of binomial rates with a common mean
    between = max(spread - noise, 1e-6)
    size = min(max(mean * (1 - mean) / between - 1, 2.0), 1e4)
    return mean * size, (1 - mean) * size


#: The rules that hosts are judged by; `own` is a document's own failure, the others are soft.
RULES = {"own": "base_failed", "symbols": "10 * n_symbols > word_chars", "lines": "5 * n_dup_lines > n_words"}


def host_verdicts(stats: DataFrame, limit: float = 0.9, prior: tuple[float, float] | None = None) -> DataFrame:
    """host, n, and for each rule its failures and shrunk rate; host_rejected, strict_symbols, strict_lines."""
    hosts = stats.filter("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(F.expr(test).cast("long"), F.lit(0))).alias(f"failed_{k}") for k, test in RULES.items()])
    hosts = settle(hosts, "hosts")
    for k in RULES:
        a, b = prior or beta_prior(hosts.withColumn("failed", F.col(f"failed_{k}")))
        hosts = hosts.withColumn(f"rate_{k}", (F.col(f"failed_{k}") + F.lit(a)) / (F.col("n") + F.lit(a + b)))
        above = F.lit(limit) if k == "own" else F.lit(a / (a + b))
        hosts = hosts.withColumn("host_rejected" if k == "own" else f"strict_{k}", F.col(f"rate_{k}") > above)
    return hosts


def judge(docs: DataFrame, host: str = "source", limit: float = 0.9) -> DataFrame:
    """Per row: doc_id, host, the counts, base_failed, the host's shrunk_rate, symbol_rate and line_rate, kept."""
    stats = settle(document_stats(docs, host), "quality")
    hosts = settle(host_verdicts(stats, limit), "hosts").select("host", F.col("rate_own").alias("shrunk_rate"), F.col("rate_symbols").alias("symbol_rate"), F.col("rate_lines").alias("line_rate"), "host_rejected", "strict_symbols", "strict_lines")
    out = lookup_join(stats, hosts, "host", salt=F.col("doc_id"))
    soft = [F.col(f"strict_{k}") & F.expr(RULES[k]) for k in ("symbols", "lines")]
    rejected = F.coalesce(F.col("host_rejected"), F.lit(False))
    for test in soft:
        rejected = rejected | F.coalesce(test, F.lit(False))
    return out.withColumn("kept", ~(F.col("base_failed") | rejected)).drop("host_rejected", "strict_symbols", "strict_lines")
