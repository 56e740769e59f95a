"""Hard negatives, Merkle manifest and suffix dedup against plain versions, on odd tables and on both sides of their switches."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import hardneg, merkle, suffixdedup
from tidemark.llm.grouping import suffix_array

DOCS = "doc_id long, text string, lang string, source string, n_chars long, place string, anchor int, low string, piece int"


def docs_of(spark, rows):
    full = [(i, t, lang, src, None if t is None else len(t), "x", 1, None, 2) for i, t, lang, src in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def test_suffix_array_equals_sorting():
    draw = random.Random(5)
    for _ in range(3000):
        text = [draw.randint(0, draw.randint(0, 3)) for _ in range(draw.randint(0, 40))]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    assert suffix_array([7] * 5000) == list(range(4999, -1, -1))


def plain_removal(rows):
    """(n_bytes, n_removed, n_spans, sha256) by looking every window up."""
    windows = [(i, (t or "").encode()) for i, t, *_ in rows]
    least = {}
    for i, b in windows:
        for k in range(len(b) - 49) if i is not None else ():
            least[b[k : k + 50]] = min(i, least.get(b[k : k + 50], i))
    out = []
    for i, b in windows:
        gone = bytearray(len(b))
        for k in range(len(b) - 49) if i is not None else ():
            if least[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def odd_texts():
    draw = random.Random(11)
    words = lambda n: "".join(draw.choice("abcdefghij é\n") for _ in range(n))
    passage, line = words(300), words(70)
    rows = [(k, words(draw.randint(0, 200)) + line + words(draw.randint(0, 90)), "en", "s") for k in range(60)]
    rows += [(100 + k, words(40) + passage[k : 250 - k] + words(40), None, None) for k in range(12)]
    rows += [(200 + k, passage, "fr", "s") for k in range(10)] + [(300, "a" * 9000, "en", "s"), (301, "a" * 4500 + "b" * 60, "en", "s"), (302, "ab" * 3000, "en", "s")]
    rows += [(400, "", "en", "s"), (401, None, "en", "s"), (402, passage[:49], "en", "s"), (403, passage[:50], "en", "s")]
    rows += [(None, passage, "en", "s"), (50, passage, "en", "s"), (50, words(30) + passage, "en", "s"), (405, line, "en", "s"), (405, line, "en", "s"), (406, "x\x00" * 40 + line, "en", "s")]
    return rows


@pytest.mark.parametrize("bucket", [suffixdedup.BUCKET, 3])
def test_repeats_are_removed_as_by_looking_up(spark, bucket):
    rows = odd_texts()
    out = suffixdedup.drop_repeats(docs_of(spark, rows), bucket)
    found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()]
    assert sorted(found, key=str) == sorted(plain_removal(rows), key=str)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows = odd_texts()
    monkeypatch.setattr(suffixdedup, "MAX_BITS", 8)
    monkeypatch.setattr(suffixdedup, "MIN_BITS", 8)
    found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.drop_repeats(docs_of(spark, rows)).collect()]
    assert sorted(found, key=str) == sorted(plain_removal(rows), key=str)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    def leaf(i, text, lang, src, n):
        return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, src, lang, n, text)])

    def climb(nodes, paths):
        """The top of a tree; paths[k] collects the sides of leaf k."""
        owners = [[k] for k in range(len(nodes))]
        while len(nodes) > 1:
            runs = [nodes[k : k + 8] for k in range(0, len(nodes), 8)]
            for r, run in enumerate(runs):
                for k in range(len(run)):
                    for o in owners[8 * r + k]:
                        paths[o].append(("".join(run[:k]), "".join(run[k + 1 :])))
            owners = [sum(owners[k : k + 8], []) for k in range(0, len(owners), 8)]
            nodes = [h(*run) for run in runs]
        return nodes[0]

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    made, tops = [], []
    for lang in langs:
        own = []
        for i, t, _, src in (r for r in rows if r[2] == lang):
            n = None if t is None else len(t)
            low = None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
            hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
            own.append((i, leaf(i, t, lang, src, n), leaf(i, low if hit else t, lang, src, n)))
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        paths = [[] for _ in own]
        tops.append(climb([x[1] for x in own], paths))
        made.append((own, paths))
    over = [[] for _ in langs]
    root = climb(list(tops), over)
    out = []
    for (own, paths), top, above in zip(made, tops, over, strict=True):
        for (i, leaf_, now), path in zip(own, paths, strict=True):
            for a, b in path + above:
                now = h(a, now, b)
            out.append((i, leaf_, top, root, h(*[x for side in path + above for x in side]), now, now == root))
    return out


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest_equals_a_plain_one(spark, levels):
    rows = [(k, f"Text {k}" if k % 11 else None, ["en", "fr", None, "É", "z"][min(k % 9, 4)], None if k % 7 == 0 else f"s{k}") for k in range(230)]
    rows += [(5, "Twice", "en", "s"), (5, "Twice", "en", "s"), (5, "twice", "en", "s"), (None, "No id", "en", "s"), (900, "", "alone", "s"), (901, "Y" * 100_000, "en", "s")]
    rows += [(1000 + k, "a", f"lang{k}", "s") for k in range(70)]
    found = merkle.manifest(docs_of(spark, rows), merkle.lowered_third(), levels)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = sorted([tuple(r) for r in found.collect()], key=str)
    assert found == sorted(plain_manifest(rows), key=str)
    assert {r[6] for r in found} == {True, False}


def plain_mining(rows):
    live = [(k, i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, [math.floor(256 * x) for x in v]) for k, (i, v, lab) in enumerate(rows) if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for ak, ai, alab, av in live:
        if ai is None or ai % 50:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(av, v, strict=False)), i is None, i or 0, k, i, lab) for k, i, lab, v in live if k != ak), key=lambda x: x[:4])
        for p in [s for s in scored if s[5] == alab][:5]:
            good = [s for s in scored if s[5] != alab and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:3]
            out += [(ai, p[4], n + 1, s[4], -p[0], -s[0]) for n, s in enumerate(good)]
    return sorted(out, key=str)


def vectors(spark, rows, kind="float"):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, row int, v string")
    return df.repartition(3)


def mined(spark, rows, kind="float"):
    return sorted([tuple(r) for r in hardneg.mine(vectors(spark, rows, kind), hardneg.contract_label(), F.col("vec_id") % 50 == 0).collect()], key=str)


@pytest.mark.parametrize("step", [hardneg.ROW_STEP, 16])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, step):
    monkeypatch.setattr(hardneg, "ROW_STEP", step)
    monkeypatch.setattr(hardneg, "ANCHORS", 5)
    monkeypatch.setattr(hardneg, "ROWS", 200)
    draw = random.Random(3)
    base = [[draw.gauss(0, 0.2) for _ in range(9)] for _ in range(6)]
    rows = [(k, [x + draw.gauss(0, 0.12) for x in base[draw.randrange(6)]], draw.randrange(4)) for k in range(600)]
    rows += [(600 + k, base[0], k % 3) for k in range(200)]  # copies: all scores tie
    rows += [(1000, None, 1), (1050, [0.1] * 9, None), (1100, [float("nan")] * 9, 1), (1150, [0.2, None, *[0.1] * 7], 1), (1200, [float("inf")] * 9, 1)]
    rows += [(1250, [], 2), (1300, [0.5], 1), (1350, [0.0] * 9, 3), (None, base[0], 1), (None, base[1], 2), (0, base[0], 1), (0, base[0], 1)]
    import numpy as np

    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    assert mined(spark, rows) == plain_mining(rows)


def test_scores_beyond_exact_doubles(spark):
    draw = random.Random(4)
    rows = [(k, [draw.uniform(-4e5, 6e5) for _ in range(4)], k % 2) for k in range(120)]
    assert mined(spark, rows, "double") == plain_mining(rows)


def test_empty_tables(spark):
    assert mined(spark, []) == []
    none = docs_of(spark, [(1, "a", "en", "s")]).filter("false")
    assert merkle.manifest(none, merkle.lowered_third()).collect() == []
    assert suffixdedup.drop_repeats(none).collect() == []
    assert mined(spark, [(50, [0.1], 1)]) == []


def test_filters_leave_the_machines(spark, monkeypatch):
    """Each machine keeps a copy of a broadcast on its disk until it is destroyed."""
    from pyspark.core.broadcast import Broadcast

    gone, destroy = [], Broadcast.destroy
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a, **k: (gone.append(self), destroy(self, *a, **k))[1])
    text = "a passage of more than fifty bytes that stands in several of these documents"
    rows = [(k, f"{k} {text} {k * k}" if k else text, "en", "s") for k in range(6)]
    found = {r.doc_id: r.n_removed for r in suffixdedup.drop_repeats(docs_of(spark, rows)).collect()}
    assert len(gone) == 2 and found[0] == 0 and all(found[k] >= len(text) for k in range(1, 6))
