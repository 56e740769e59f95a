"""Personal data: base spans by pattern, disclosing terms by corpus co-occurrence, and sanitised texts. SQL functions only.

Base spans are e-mail addresses, IPv4 addresses, payment cards and phone numbers. Each span's value is a protected entity,
and so is its pool: the address's domain, the IP's first three parts, the card's issuer digits, the number's first digits.
A term (a run of three or more letters outside base spans, anywhere in a text with an entity) discloses it by their pointwise
mutual information over all other documents, as a share of the entity's own information there:
log(N * both / (entity * term)) / log(N / entity), each of the three counts with `SMOOTHING` added. A document is no evidence
about itself: all counts leave it out, and a term met with an entity in no other document tells nothing about it. So an
entity of one document is protected through its pools. Terms are generalised from the share `generalise` on, and removed from
`remove` on, wherever they occur in a text with that entity. Term counts are over all documents and whole texts.

Pairs are pruned without loss: as no pair occurs together in more documents than its entity, a term's own count alone bounds
its share. Entities of the same documents share their pairs' counts, so they are rated as one.

Work is linear in a text, but for sorting its words: positions are running sums by blocks, terms are found by one sort of the
text's words with them, and spans are cut from a form of fixed width.

Patterns find leftmost matches that do not overlap within a kind; matches that fail their test are dropped without another
try. Where a pattern could only start inside a run of its own characters after failing at the run's first one, a look-behind
spares the attempt, and possessive quantifiers stand where backtracking cannot help, so long runs stay linear.

A null text counts as empty and stays null in sanitised output; empty texts and empty tables give no spans. doc_id may be
null or repeated: rows are judged each by itself, and copies count as often as they occur. Spans that overlap become one
replacement, that of the span that starts first. Other columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_settled, lookup_join, settle, sheltered

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for its kind's pattern to be worth trying.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_IP = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
#: Added to each document count.
SMOOTHING = 0.5
_TERM = r"\p{L}{3,}"
#: Values folded at a time.
BLOCK = 512
#: Digits that name a card's issuer, and a phone number's region.
ISSUER_DIGITS, PREFIX_DIGITS = 6, 5
_SPANS = "array<struct<start:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with the value computed once."""
    return F.transform(F.array(value), fn)[0]


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Each prefix of an array of non-negative ints folded by `op` (a sum or maximum), block by block: an array that grows by
    one for each value is copied each time, so no long one may."""

    def scan(block: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(op(acc["at"], x))).alias("out"))
        return F.aggregate(block, start, step, lambda acc: acc["out"])

    def whole(array: Column) -> Column:
        last = F.floor((F.greatest(F.size(array), F.lit(1)) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: scan(F.slice(array, k * BLOCK + 1, F.lit(BLOCK))))
        ends = lambda folded: scan(F.transform(folded, lambda b: F.coalesce(F.get(b, F.size(b) - 1), F.lit(0))))
        shifted = lambda folded: F.zip_with(folded, F.concat(F.array(F.lit(0)), ends(folded)), lambda b, before: F.transform(b, lambda x: op(before, x)))
        return _bind(blocks, lambda folded: F.flatten(F.filter(shifted(folded), lambda b: b.isNotNull())))

    return _bind(values, whole)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def matches(text: Column, pattern: str, wanted: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<start, end, value>> of the pattern's matches whose value is wanted, in code points.

    What lies between the matches gives the positions.
    """
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("value")))

    def placed(p: Column) -> Column:
        ends = running(F.transform(p, lambda x: x["gap"] + F.coalesce(F.length(x["value"]), F.lit(0))), _plus)
        spans = F.zip_with(p, ends, lambda x, end: F.struct((end - F.length(x["value"])).alias("start"), end.alias("end"), x["value"].alias("value")))
        return F.filter(spans, lambda s: s["value"].isNotNull() if wanted is None else s["value"].isNotNull() & wanted(s["value"]))

    return _bind(pieces, placed)


def rewritten(text: Column, spans: Column, put: Callable[[Column, Column, Column], Column]) -> Column:
    """The text with put(span, begin, end) in place of each span (sorted by start), where begin leaves out what earlier ones cover."""
    mark = F.unhex(F.lit("0000FEFF"))  # the decoder takes one byte order mark; U+FEFF of the text stays

    def cut(wide: Column, begin: Column, end: Column) -> Column:
        return F.decode(F.concat(mark, F.substring(wide, begin * 4 + 1, (end - begin) * 4)), "UTF-32")

    def built(bound: Column) -> Column:
        wide, ends = bound["wide"], bound["ends"]
        since = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))  # noqa: E731  where the spans before the i-th have ended
        piece = lambda s, i: F.concat(cut(wide, since(i), F.greatest(since(i), s["start"])), put(s, F.greatest(since(i), s["start"]), F.get(ends, i)))
        return F.concat(F.array_join(F.transform(bound["spans"], piece), ""), cut(wide, since(F.size(ends)), (F.octet_length(wide) / 4).cast("int")))

    ended = F.transform(spans, lambda s: s["end"])
    return _bind(F.struct(F.encode(text, "UTF-32").alias("wide"), running(ended, F.greatest).alias("ends"), spans.alias("spans")), built)


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(_IP)
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The spans of one kind in a text."""
    hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(HINTS[kind])
    wanted = None if kind == "email" else lambda value: _passes(kind, value)
    return F.when(hint, matches(text, PATTERNS[kind], wanted)).otherwise(F.array().cast(_SPANS))


def _entity(kind: str, value: Column) -> Column:
    return F.concat(F.lit(kind + ":"), F.lower(value) if kind in ("email", "ip") else _digits(value))


def _pool(kind: str, value: Column) -> Column:
    """What many entities of a kind share."""
    if kind == "email":
        shared = F.lower(F.substring_index(value, "@", -1))
    elif kind == "ip":
        shared = F.substring_index(value, ".", 3)
    else:
        shared = F.substring(_digits(value), 1, ISSUER_DIGITS if kind == "card" else PREFIX_DIGITS)
    return F.concat(F.lit(f"{kind} pool:"), shared)


def find_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """A settled table: the columns `keep`, _row, one array of spans for each kind, _entities, and _rest, the text without
    its spans (null where there is no entity)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(*keep, text.alias("_text")).withColumns({f"_{k}": base_spans(F.col("_text"), k) for k in KINDS})
    named = lambda kind: F.flatten(F.transform(F.col(f"_{kind}"), lambda s: F.array(_entity(kind, s["value"]), _pool(kind, s["value"]))))
    entities = F.array_distinct(F.concat(*[named(k) for k in KINDS]))
    spans = F.array_sort(F.concat(*[F.transform(F.col(f"_{k}"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS]))
    rest = F.when(F.size("_entities") > 0, rewritten(F.col("_text"), spans, lambda s, begin, end: F.repeat(F.lit(" "), end - begin)))
    found = found.withColumn("_entities", entities)
    return settle(found.select(*keep, F.monotonically_increasing_id().alias("_row"), *[f"_{k}" for k in KINDS], "_entities", rest.alias("_rest")), "spans")


def entity_rows(found: DataFrame) -> DataFrame:
    """(_row, entity, with_entity): the entities of each row that other rows have too, and the number of rows with them.
    Entities of the same rows are one, named by two hashes over those rows."""
    each = found.select("_row", F.explode("_entities").alias("entity"))
    hashed = lambda seed: F.bit_xor(F.xxhash64("_row", F.lit(seed)))
    sizes = each.groupBy("entity").agg(F.count(F.lit(1)).alias("with_entity"), F.struct(hashed(1).alias("a"), hashed(2).alias("b")).alias("rows"))
    joined = lookup_join(each, sizes.filter("with_entity > 1"), "entity", salt=F.col("_row")).filter("with_entity IS NOT NULL")
    return joined.select("_row", F.col("rows").alias("entity"), "with_entity").distinct()


def disclosing_terms(docs: DataFrame, found: DataFrame, generalise: float = 0.7, remove: float = 0.9) -> DataFrame:
    """(_row, term, action) of the terms that disclose an entity of their row; action 1 generalises, 2 removes."""
    n = float(found.count() - 1)
    entities = settle(entity_rows(found), "entities")
    others = lambda c: F.col(c) - 1 + SMOOTHING
    bound = others("with_entity") * F.pow(F.lit(n) / others("with_entity"), F.lit(1 - generalise)) * (1 + 1e-9)  # of a term's count
    widest = F.lit(entities.agg(F.max(bound)).first()[0] or 0.0)
    terms = lambda text: F.explode(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)), F.lower))).alias("term")
    counts = docs.select(terms("text")).groupBy("term").agg(F.count(F.lit(1)).alias("with_term")).filter((F.col("with_term") > 1) & (others("with_term") <= widest))
    per_row = entities.groupBy("_row").agg(F.max(bound).alias("_bound"))
    inside = found.filter("_rest is not null").select("_row", "_rest").join(per_row, "_row").select("_row", "_bound", terms("_rest"))
    rare = inside.join(counts, "term").filter(others("with_term") <= F.col("_bound")).drop("_bound")
    pairs = settle(rare.join(entities, "_row").filter(others("with_term") <= bound), "pairs")

    own = F.log(F.lit(n) / others("with_entity"))
    share = F.log(F.lit(n) * others("both") / (others("with_entity") * others("with_term"))) / own
    both = pairs.groupBy("entity", "term", "with_entity", "with_term").agg(F.count(F.lit(1)).alias("both")).filter("both > 1")
    # shares of exactly 1 may come out a few ulp lower
    rated = both.withColumn("share", F.when(own > 0, share + 1e-12).otherwise(0.0)).filter(F.col("share") >= generalise)
    rated = settle(rated.select("entity", "term", F.when(F.col("share") >= remove, F.lit(2)).otherwise(F.lit(1)).alias("action")), "disclosing")
    out = settle(pairs.select("_row", "entity", "term").join(rated, ["entity", "term"]).groupBy("_row", "term").agg(F.max("action").alias("action")), "row-terms")
    drop_settled(docs.sparkSession, entities, pairs, rated)
    return out


def _marked(text: Column, bad: Column) -> Column:
    """array<struct<start, end, action>> of the words of the text that are among the terms: both sorted as one array, in which
    a term stands before its words."""
    terms = F.transform(bad, lambda b: F.struct(b["term"].alias("term"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), b["action"].alias("action")))
    words = F.transform(matches(text, _TERM), lambda w: F.struct(F.lower(w["value"]).alias("term"), w["start"].alias("start"), w["end"].alias("end"), F.lit(0).alias("action")))

    def found(every: Column) -> Column:
        last = running(F.transform(every, lambda x, i: F.when(x["start"] < 0, i + 1).otherwise(0)), F.greatest)
        term = lambda k: F.get(every, k - 1)
        spans = F.zip_with(every, last, lambda x, k: F.when((x["start"] >= 0) & (term(k)["term"] == x["term"]), F.struct(x["start"].alias("start"), x["end"].alias("end"), term(k)["action"].alias("action"))))
        return F.array_sort(F.array_compact(spans))

    return _bind(F.array_sort(F.concat(terms, words)), found)


def detect(docs: DataFrame, keep: list[str] | None = None, **thresholds) -> DataFrame:
    """The columns `keep`, arrays email, ip, card, phone of spans, and term of (start, end, action)."""
    keep = docs.columns if keep is None else keep
    found = find_spans(docs, keep)
    bad = disclosing_terms(docs, found, **thresholds).groupBy("_row").agg(F.collect_list(F.struct("term", "action")).alias("_bad"))
    out = found.drop("_entities").join(bad, "_row", "left")
    empty = F.array().cast("array<struct<start:int,end:int,action:int>>")
    return out.select(*keep, *[f"_{k}" for k in KINDS], F.when(F.col("_bad").isNotNull(), _marked(F.col("_rest"), F.col("_bad"))).otherwise(empty).alias("_term"))


def span_list(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans of the kinds, by kind as listed, then start."""
    def one(kind: str) -> Column:
        return F.transform(F.col(f"_{kind}"), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*[one(k) for k in kinds]), ",")


def span_digests(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, a count for each kind, base_sha256, spans, n_terms."""
    found = detect(docs, ["doc_id"])
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_list(KINDS).cast("binary"), 256).alias("base_sha256"), span_list((*KINDS, "term")).alias("spans"), F.size("_term").cast("long").alias("n_terms"))


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """`docs` with each base span replaced by its kind, disclosing terms by `[TERM]` or nothing; overlapping spans become one."""
    docs, restore = sheltered(docs, ("text",))
    found = detect(docs, **thresholds)
    label = lambda kind: F.transform(F.col(f"_{kind}"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("label")))
    terms = F.transform("_term", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["action"] == 2, F.lit("")).otherwise(F.lit("[TERM]")).alias("label")))
    spans = F.array_sort(F.concat(*[label(k) for k in KINDS], terms))

    clean = rewritten(F.col("text"), spans, lambda s, begin, end: F.when(s["start"] >= begin, s["label"]).otherwise(""))
    touched = F.size("_email") + F.size("_ip") + F.size("_card") + F.size("_phone") + F.size("_term") > 0
    return restore(found.withColumn("text", F.when(touched, clean).otherwise(F.col("text"))))
