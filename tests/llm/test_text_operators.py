import hashlib
import math
import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, key string"
LETTERS = list("ab.@-+ 0123456789()é_%\n\U0001f600") + ["4111 1111 1111 1111", "+49 30 1234567", "1.2.3.4", "a@b.co", "0255.1.1.1", "256.1.1.1"]


def frame(spark, texts, lang="xx", source="s"):
    return spark.createDataFrame([(i, t, lang, source, "k") for i, t in enumerate(texts)], SCHEMA)


def noise(n, seed=3, letters=LETTERS):
    r = random.Random(seed)
    return ["".join(r.choices(letters, k=r.randint(0, 40))) for _ in range(n)]


# personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def spans(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if passes(k, m.group())] for k, p in PATTERNS.items()}


def test_base_spans_match_brute_force(spark):
    from tidemark.llm.pii import span_digests

    texts = [*noise(1500), None, "", "a" * 100_000, "1" * 50_000, "a.b@c.d" * 300]
    got = {r.doc_id: r for r in span_digests(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        if i == len(texts) - 3:
            continue  # the plain patterns are quadratic on this one
        want = spans(t)
        base = ",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in want[k])
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(len(want[k]) for k in PATTERNS), repr(t)
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert got[i].spans.startswith(base)


def test_disclosing_terms(spark):
    from tidemark.llm.pii import sanitise, span_digests

    texts = [f"the zanzibar office, write to boss@corp.example today {i}" for i in range(4)] + ["the office writes today"] * 200
    docs = frame(spark, texts)
    got = {r.doc_id: r.spans for r in span_digests(docs).collect()}
    at = texts[0].index("zanzibar")
    assert f"term:{at}:{at + 8}" in got[0] and "term" not in got[50]
    clean = {r.doc_id: r for r in sanitise(docs).collect()}
    assert "zanzibar" not in clean[0].text and "boss@" not in clean[0].text and "[EMAIL]" in clean[0].text
    assert clean[50].text == texts[50] and clean[50].key == "k"
    assert sanitise(frame(spark, [])).count() == 0 and sanitise(frame(spark, [None])).first().text is None


def term_rule(texts, generalise=0.7, remove=0.9):
    """The terms of each text by plain counting over all other texts, with their actions."""
    words = lambda t: {w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)}
    plain = [blank(t) for t in texts]
    terms, whole = [words(t) for t in plain], [words(t) for t in texts]
    digits = lambda v: re.sub("[^0-9]", "", v)
    name = {"email": str.lower, "ip": str.lower, "card": digits, "phone": digits}
    pool = {"email": lambda v: v.lower().rpartition("@")[2], "ip": lambda v: ".".join(v.split(".")[:3]), "card": lambda v: digits(v)[:6], "phone": lambda v: digits(v)[:5]}
    values = [[(k, t[a:b]) for k, found in spans(t).items() for a, b in found] for t in texts]
    entities = [{(k, name[k](v)) for k, v in x} | {("pool", k, pool[k](v)) for k, v in x} for x in values]
    with_term, with_entity = Counter(w for x in whole for w in x), Counter(e for x in entities for e in x)
    both = Counter((e, w) for x, ws in zip(entities, terms) for e in x for w in ws)
    n, out = len(texts) - 1, []
    for x, t in zip(entities, plain):
        marks = []
        for m in re.finditer(r"[^\W\d_]{3,}", t):
            w = m.group().lower()
            shares = [0.0]
            for e in x:
                if both[e, w] > 1 and n > with_entity[e] - 0.5:
                    shares.append(math.log(n * (both[e, w] - 0.5) / ((with_entity[e] - 0.5) * (with_term[w] - 0.5))) / math.log(n / (with_entity[e] - 0.5)) + 1e-12)
            if max(shares) >= generalise:
                marks.append((m.start(), m.end(), 2 if max(shares) >= remove else 1))
        out.append(marks)
    return out


def blank(text):
    for a, b in sorted(x for found in spans(text).values() for x in found):
        text = text[:a] + " " * (b - a) + text[b:]
    return text


def test_terms_of_rare_entities_in_whole_texts(spark):
    from tidemark.llm.pii import detect, sanitise

    r = random.Random(8)
    vocabulary = ["".join(r.choices("abcdefghijklmnoprstuvwxyz", k=r.randint(3, 7))) for _ in range(300)]
    texts = [" ".join(r.choices(vocabulary, weights=range(300, 0, -1), k=60)) for _ in range(150)]
    for i in range(40):
        texts[i] += f" \U0001f600 mail p{i % 17}@x.org or q{i}@y.org"
    for i in range(40, 60):
        texts[i] = f"\ufeffcall +44 20 7946 0{i % 6}18, host 10.1.{i % 5}.{i}, card 4111 1111 1111 1111 " + texts[i]
    for i in (0, 17, 34):
        texts[i] = "(Zanzibar) office " + texts[i] + " and zanzibar again"
    texts[1] = "“Łódź-Mombasa” " + "the road goes on " * 400 + texts[1]
    texts[35] += " mombasa"  # another address of the same domain
    texts[2] += " loneword"
    want = term_rule(texts)
    got = {x.doc_id: [tuple(s) for s in x._term] for x in detect(frame(spark, texts)).collect()}
    assert got == dict(enumerate(want)) and {a for x in want for _, _, a in x} == {1, 2}
    clean = {x.doc_id: x.text for x in sanitise(frame(spark, texts)).collect()}
    assert "anzibar" not in clean[0] and "Mombasa" not in clean[1] and clean[60] == texts[60]
    assert "loneword" in clean[2] and clean[40].startswith("\ufeff") and "[PHONE]" in clean[40]  # one document is no evidence about itself


def test_sanitising_is_linear_in_a_text(spark):
    from tidemark.llm.pii import detect, sanitise

    words = ["".join(chr(97 + (i // 26**k) % 26) for k in range(5)) for i in range(30_000)]
    text = "a@b.org " + " ".join(words) + " c@d.org " * 3000
    rows = frame(spark, [text, text, "plain words"])
    assert [len(r._term) for r in detect(rows).orderBy("doc_id").collect()] == [len(x) for x in term_rule([text, text, "plain words"])]
    many = frame(spark, [text, text] + [f"plain words {i}" for i in range(200)])
    clean = {r.doc_id: r.text for r in sanitise(many).collect()}
    assert clean[0] == clean[1] and clean[0].split() == ["[EMAIL]"] * 3001 and clean[9] == "plain words 7"


# lines


def line_rule(texts, least):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    seen = Counter()
    for t in texts:
        seen.update({k for k in map(key, (t or "").split("\n")) if k})
    return [[x for x in (t or "").split("\n") if seen[key(x)] < least] for t in texts]


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_repeated_lines(spark, broadcast):
    from tidemark.llm.linededup import drop_repeated_lines

    r = random.Random(5)
    pool = ["", " ", "Common Line", " common line\r", "Été", "rare", *(f"l{i}" for i in range(40))]
    texts = ["\n".join(r.choices(pool, k=r.randint(0, 6))) for _ in range(120)] + [None, "", "\n\n"]
    rows = drop_repeated_lines(frame(spark, texts), min_docs=10, broadcast_keys=broadcast).collect()
    assert len(rows) == len(texts)
    for row in rows:
        keep = line_rule(texts, 10)[row.doc_id]
        assert row.kept_sha256 == hashlib.sha256("\n".join(keep).encode()).hexdigest()
        assert (row.n_lines, row.n_dropped) == (len((texts[row.doc_id] or "").split("\n")), len((texts[row.doc_id] or "").split("\n")) - len(keep))
        assert row.key == "k" and (row.text is None) == (texts[row.doc_id] is None)
    assert drop_repeated_lines(frame(spark, [])).count() == 0


def test_full_filters_change_nothing(spark, monkeypatch):
    from tidemark.llm import linededup

    texts = [f"unique {i}\nshared" for i in range(60)]
    monkeypatch.setattr(linededup, "MAX_BITS", 1 << 15)
    monkeypatch.setattr(linededup, "MIN_BITS", 1 << 15)
    monkeypatch.setattr(linededup, "MERGED", 3)  # and filters merge in two steps
    got = linededup.drop_repeated_lines(frame(spark, texts).repartition(9), min_docs=10)
    assert {r.text for r in got.collect()} == {f"unique {i}" for i in range(60)}


def test_first_occurrence_stays(spark):
    from tidemark.llm.linededup import drop_repeated_lines

    got = drop_repeated_lines(frame(spark, ["a\nb\nA", "b\nc", "b"]), min_docs=2, keep_first=True).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["a\nb\nA", "c", ""]


# quality


def test_quality_counts(spark):
    from tidemark.llm.quality import COUNTS, judge

    r = random.Random(6)
    texts = [" ".join(r.choices(["a", "b", "été", "#x", "\n", "c|d"], k=r.randint(0, 60))) for _ in range(200)] + [None, "", "x " * 5000]
    rows = {x.doc_id: x for x in judge(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        hit = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))
        assert tuple(rows[i][c] for c in COUNTS) == want
        assert rows[i].base_failed == (len(words) < 10 or 100 * len(hit) > 20 * len(words))


def test_soft_rules_of_strict_hosts(spark):
    from tidemark.llm.quality import judge

    plain = "one two three four five six seven eight nine ten eleven"
    table = "| ".join(plain.split()) + " ||"
    rows = [(i, table if i < 60 else plain, "x", "tables", "k") for i in range(100)] + [(1000 + i, table if i == 0 else plain, "x", f"h{i % 10}", "k") for i in range(500)]
    out = {r.doc_id: r for r in judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(not out[i].kept and not out[i].base_failed for i in range(60)) and all(out[i].kept for i in range(60, 100))
    assert out[1000].kept and out[0].symbol_rate > out[1000].symbol_rate  # the same rule, a host like the others


CLASHES = ("_row", "_email", "_text", "_term", "_bad", "_gone", "_once", "_salt", "key", "row", "hit", "segment", "n_lines", "score", "lang_pred", "kept0__", "group")


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_clashing_columns_stay(spark, broadcast):
    from tidemark.llm.langid import identify
    from tidemark.llm.linededup import drop_repeated_lines
    from tidemark.llm.pii import sanitise

    fields = ", ".join(f"`{c}` int" for c in CLASHES)
    rows = [(i, "mail a@b.org\nshared line", "xx", *range(len(CLASHES))) for i in range(12)] + [(99, None, "xx", *range(len(CLASHES)))]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, {fields}")
    clean = sanitise(docs)
    assert clean.columns == docs.columns and all(tuple(r)[3:] == tuple(range(len(CLASHES))) for r in clean.collect())
    lines = drop_repeated_lines(docs, broadcast_keys=broadcast)
    others = [c for c in CLASHES if c != "n_lines"]
    assert all([r[c] for c in others] == [CLASHES.index(c) for c in others] and r.text in (None, "") for r in lines.collect())
    named = identify(docs, train=F.lit(True)).collect()
    assert len(named) == 13 and all(r._row == 0 and r.group == len(CLASHES) - 1 for r in named)


def test_host_verdicts(spark):
    from tidemark.llm.common import lookup_join
    from tidemark.llm.quality import host_verdicts, judge

    good, bad = "one two three four five six seven eight nine ten eleven", "short"
    rows = [(i, bad if i % 50 else good, "x", "spam", "k") for i in range(400)] + [(1000 + i, good, "x", f"h{i % 9}", "k") for i in range(400)] + [(2000, bad, "x", "tiny", "k"), (3000, good, "x", None, "k")]
    out = {r.doc_id: r for r in judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not out[0].kept and not out[0].base_failed  # a good document of a rejected host
    assert out[1000].kept and out[3000].kept and out[3000].shrunk_rate is None
    assert out[2000].shrunk_rate < out[0].shrunk_rate
    assert judge(spark.createDataFrame([], SCHEMA)).count() == 0
    left = spark.range(50).select("id", (F.col("id") % 3).alias("k"))
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    wide, salted = (sorted((r.id, r.v or "") for r in lookup_join(left, small, "k", max_rows=m).collect()) for m in (10, 0))
    assert wide == salted and len(wide) == 50


# language


def test_language_held_out(spark):
    from tidemark.llm.langid import identify

    r = random.Random(7)
    parts = {"en": ["the", "ing", "and", "er", "th", "on"], "de": ["sch", "ung", "und", "ei", "ch", "ver"], "fr": ["eau", "que", "les", "oi", "ment", "tion"]}
    word = lambda k: "".join(r.choices(parts[k], k=r.randint(1, 3)))
    rows = [(i, " ".join(word(k) for _ in range(30)), k, "s", "k") for i in range(240) for k in [list(parts)[i % 3]]]
    rows += [(900, None, "en", "s", "k"), (901, "12 34 !!", "en", "s", "k"), (902, "the", None, "s", "k"), (903, "schung" * 4000, None, "s", "k")]
    out = {x.doc_id: x for x in identify(spark.createDataFrame(rows, SCHEMA), train=F.col("doc_id") % 4 != 1).collect()}
    assert all(out[i].lang_pred == k for i, _, k, *_ in rows[:240])
    assert (out[900].lang_pred, out[900].score, out[901].lang_pred) == ("und", 0.0, "und")
    assert out[903].lang_pred == "de" and 0 <= out[902].score <= 1 and out[903].key == "k"
    assert identify(spark.createDataFrame([], SCHEMA), train=F.lit(True)).count() == 0
    nothing = identify(spark.createDataFrame(rows[:3], SCHEMA), train=F.lit(False)).collect()
    assert {x.lang_pred for x in nothing} == {"und"}


def test_forward_sums_all_segmentations():
    import numpy as np

    from tidemark.llm.langid import Lattice

    pieces = {"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4}
    p = np.array([[0.3], [0.2], [0.1], [0.25], [0.15]])

    def total(w):
        return 1.0 if not w else sum(p[k, 0] * total(w[len(s) :]) for s, k in pieces.items() if w.startswith(s))

    words = ["a", "ab", "abab", "babaab"]
    assert np.allclose(np.exp(Lattice(pieces, p).score(words))[:, 0], [total(w) for w in words])
    long = ["abba" * 9, "ba" * 3000]
    direct = Lattice(pieces, p).forward(Lattice(pieces, p).edges(long[:1]))[0][0, -1, 0]
    assert np.allclose(Lattice(pieces, p).score(long)[0, 0], math.log(direct))
    alpha = [0.0, math.log(p[1, 0])]  # by hand, letter by letter, for a word whose sums would underflow
    for k in range(2, len(long[1]) + 1):
        terms = [(long[1][k - n : k], alpha[k - n]) for n in (1, 2, 3) if k >= n]
        terms = [a + math.log(p[pieces[w], 0]) for w, a in terms if w in pieces]
        alpha.append(max(terms) + math.log(sum(math.exp(t - max(terms)) for t in terms)))
    assert np.allclose(Lattice(pieces, p).score(long)[1, 0], alpha[-1])
    lattice = Lattice(pieces, p)
    whole, short = lattice.expect(["abba" * 9], np.array([1.0]), 0), np.zeros(5)
    spread = np.exp(lattice.long_forward("abba" * 9))
    for size in (1, 2, 3):  # expected counts by forward sums of the word and of its reverse
        for k in range(36 - size + 1):
            w = ("abba" * 9)[k : k + size]
            if w in pieces:
                tail = np.exp(lattice.long_forward(("abba" * 9)[k + size :])[-1, 0])
                short[pieces[w]] += spread[k, 0] * p[pieces[w], 0] * tail / spread[-1, 0]
    assert np.allclose(whole, short)
    counts = Lattice(pieces, p).expect(["ab"], np.array([2.0]), 0)
    split, whole = 0.3 * 0.2, 0.1
    assert np.allclose(counts[:3], [2 * split / (split + whole), 2 * split / (split + whole), 2 * whole / (split + whole)])
