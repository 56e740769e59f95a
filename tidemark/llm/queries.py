"""The registered queries of the corpus operators; each reads whole tables and derives its digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: DuckDB SQL for those queries that SQL can express.
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(documents(spark, sf_dir), percent=85)


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = identify(docs, train=rest != 1)
    return found.select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, token_pieces

    return pack(token_pieces(documents(spark, sf_dir)))


@query
def op6_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import encode_media, media_digests

    return media_digests(encode_media(documents(spark, sf_dir)))


@query
def op7_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import COUNTS, judge

    rates = [F.round(c, 9).alias(c) for c in ("shrunk_rate", "symbol_rate", "line_rate")]
    return judge(documents(spark, sf_dir)).select("doc_id", *COUNTS, "base_failed", "kept", *rates)


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spm import digest_documents

    return digest_documents(documents(spark, sf_dir))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import drop_repeated_lines

    return drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"), min_docs=10, min_chars=1).drop("text")


@query
def op4_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), least=1000)


@query
def op10_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import kd_shards

    out = kd_shards(documents(spark, sf_dir), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op3_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import span_digests

    return span_digests(documents(spark, sf_dir))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hardneg import contract_label, mine

    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), contract_label(), F.col("vec_id") % 50 == 0)


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import lowered_third, manifest

    return manifest(documents(spark, sf_dir), lowered_third())


@query
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixdedup import drop_repeats

    return drop_repeats(documents(spark, sf_dir)).drop("kept")


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORD = r"[^ \t\n\x0B\f\r]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL["op4_warc_normaliser"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p),
r AS (SELECT *, strlen(html) >= 1000 AND page_id <> top AS again FROM m)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to FROM r
"""

SQL["op9_line_dedup"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT r, unnest(range(len(parts))) AS k, unnest(parts) AS line FROM d),
x AS (SELECT *, translate(trim(line, {_SPACES}), '{_UPPER}', '{_LOWER}') AS key FROM l),
bad AS (SELECT key FROM (SELECT DISTINCT r, key FROM x WHERE key <> '') GROUP BY key HAVING count(*) >= 10),
y AS (SELECT x.*, bad.key IS NOT NULL AS gone FROM x LEFT JOIN bad USING (key)),
g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS rest FROM y GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(rest) AS kept_sha256 FROM g JOIN d USING (r)
"""


def _rate(rule: str) -> str:
    """Mean and shrunk rate of one rule by host: the moments of a beta prior, weighted by documents."""
    return f"""
m_{rule} AS (SELECT sum(n) AS n, count(*) AS hosts, least(greatest(sum(f_{rule}) / sum(n), 1e-6), 1 - 1e-6) AS mean, sum(f_{rule} * f_{rule} / n) / sum(n) AS square FROM h),
b_{rule} AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(square - mean * mean - mean * (1 - mean) * hosts / n, 1e-6) - 1, 2.0), 1e4) AS size FROM m_{rule}),
r_{rule} AS (SELECT host, (f_{rule} + mean * size) / (n + (mean * size + (1 - mean) * size)) AS rate_{rule}, (f_{rule} + mean * size) / (n + (mean * size + (1 - mean) * size)) > mean AS strict_{rule} FROM h, b_{rule})"""


SQL["op7_host_quality"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '{_WORD}') AS words FROM d),
win AS (SELECT r, unnest(range(1, len(words) - 3)) AS k, words FROM w WHERE len(words) >= 5),
key AS (SELECT r, k, array_to_string(words[k:k+4], ' ') AS five FROM win),
rep AS (SELECT r, unnest(range(k, k + 5)) AS place FROM (SELECT *, count(*) OVER (PARTITION BY r, five) AS times FROM key) WHERE times > 1),
rw AS (SELECT r, count(DISTINCT place) AS n_repeat_words FROM rep GROUP BY r),
ln AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dl AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln WHERE regexp_matches(line, '{_WORD}') GROUP BY r),
c AS (SELECT d.r, doc_id, host, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN rw USING (r) LEFT JOIN dl USING (r)),
t AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 10 * n_symbols > word_chars AS symbols, 5 * n_dup_lines > n_words AS lines FROM c),
h AS (SELECT host, count(*) AS n, sum(base_failed::INT) AS f_own, sum(symbols::INT) AS f_symbols, sum(lines::INT) AS f_lines FROM t WHERE host IS NOT NULL GROUP BY host),
{_rate("own")}, {_rate("symbols")}, {_rate("lines")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR coalesce(rate_own > 0.9, false) OR coalesce(symbols AND strict_symbols, false) OR coalesce(lines AND strict_lines, false)) AS kept,
  round(rate_own, 9) AS shrunk_rate, round(rate_symbols, 9) AS symbol_rate, round(rate_lines, 9) AS line_rate
FROM t LEFT JOIN r_own USING (host) LEFT JOIN r_symbols USING (host) LEFT JOIN r_lines USING (host)
"""

SQL["op11_hard_negatives"] = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.r AS other, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, other) <= 5),
n AS (SELECT p.r, p.other, p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.r, p.other ORDER BY s.score DESC, s.vec_id NULLS LAST, s.other) AS place
  FROM p JOIN s ON s.r = p.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, place::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 3
"""


#: CRC-32 of an ASCII text, bit by bit.
_CRC32 = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT), lambda x, c: list_reduce([xor(x, c)] || range(8), lambda y, k: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"


def _leaf(text: str) -> str:
    fields = [f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)]
    return f"sha256({' || '.join(fields)})"


def _merkle_sql(levels: int) -> str:
    """Level by level, for trees of at most 8^levels leaves; a tree with one node left stays as it is."""
    step = """
n{k} AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, i // 8 AS up FROM m{k}),
r{k} AS (SELECT g, up, string_agg(d, '' ORDER BY i) AS run, any_value(n) AS n FROM n{k} GROUP BY g, up),
m{j} AS (SELECT g, up AS i, CASE WHEN n > 1 THEN sha256(run) ELSE run END AS d FROM r{k}),"""
    up = "".join(step.format(k=k, j=k + 1) for k in range(levels))
    # the tree over the subroots is one more tree, whose leaves are numbered by lang
    over = step.format(k="T0", j="T1") + step.format(k="T1", j="T2")
    sides = [(f"r{k}", f"(x.i // {8**k}) % 8") for k in range(levels)] + [("rT0", "x.g % 8"), ("rT1", "(x.g // 8) % 8")]
    left, right = (lambda r, a: f"CASE WHEN {r}.n > 1 THEN substr({r}.run, 1, 64 * ({a})) ELSE '' END"), (lambda r, a: f"CASE WHEN {r}.n > 1 THEN substr({r}.run, 64 * ({a}) + 65) ELSE '' END")
    proof = " || ".join(f"{left(r, a)} || {right(r, a)}" for r, a in sides)
    folds, before = "", "x.t"
    for k, (r, a) in enumerate(sides):
        folds += f", CASE WHEN {r}.n > 1 THEN sha256({left(r, a)} || {before} || {right(r, a)}) ELSE {before} END AS f{k}"
        before = f"f{k}"
    joins = "".join(f" JOIN r{k} ON r{k}.g = x.g AND r{k}.up = x.i // {8 ** (k + 1)}" for k in range(levels)) + " JOIN rT0 ON rT0.up = x.g // 8 JOIN rT1 ON rT1.up = x.g // 64"
    return f"""
WITH l AS (SELECT doc_id, lang, {_leaf("text")} AS d, CASE WHEN {_CRC32.format("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS t FROM documents),
b AS (SELECT doc_id, d, coalesce(t, d) AS t, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, d) - 1 AS i FROM l),
m0 AS (SELECT g, i, d FROM b),{up}
mT0 AS (SELECT 0 AS g, g AS i, d FROM m{levels}),{over}
q AS (SELECT x.doc_id, x.d AS leaf, m{levels}.d AS subroot, mT2.d AS root, sha256({proof}) AS proof_sha256{folds}
  FROM b x{joins} JOIN m{levels} ON m{levels}.g = x.g JOIN mT2 ON true)
SELECT doc_id, leaf, subroot, root, proof_sha256, {before} AS folded_root, {before} = root AS verified FROM q
"""


SQL["op12_merkle_manifest"] = _merkle_sql(8)

SQL["op13_suffix_dedup"] = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
c AS (SELECT r, doc_id, c, substr(h, 1000 * c + 1, 1098) AS part FROM (SELECT *, unnest(range(length(h) // 1000 + 1)) AS c FROM d)),
k AS (SELECT r, doc_id, 500 * c + unnest(range(length(part) // 2 - 49)) AS i, unnest(list_transform(range(length(part) // 2 - 49), lambda i: md5_number(substr(part, 2 * i + 1, 100)))) AS win FROM c WHERE length(part) >= 100),
f AS (SELECT win, min(doc_id) AS low FROM k GROUP BY win HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT r, i FROM k JOIN f USING (win) WHERE doc_id > low),
cut AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 50, true)::INT AS fresh FROM hit),
run AS (SELECT r, n, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS n FROM cut) GROUP BY r, n),
gap AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM run),
part AS (SELECT r, before, a FROM gap UNION ALL SELECT d.r, coalesce(max(b), 0), length(any_value(h)) // 2 FROM d LEFT JOIN run USING (r) GROUP BY d.r),
kept AS (SELECT part.r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY before) AS rest FROM part JOIN d USING (r) GROUP BY part.r),
s AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed FROM run GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(rest)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN s USING (r)
"""
