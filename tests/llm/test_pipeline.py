import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, tmp_path):
    good = [f"the morning train number {i} left the old station with many people and several heavy boxes on board today" for i in range(30)]
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango".split()
    base = " ".join(f"{a} {b}" for a in words for b in words[:6])
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good)]
    rows += [(100, base, "en", "s", len(base)), (101, base + " extra", "en", "s", 1), (102, "12 !!", "en", "s", 5), (103, None, None, None, None)]
    rows += [(200 + i, f"cookie notice\n{t} again with mail to x{i}@y.org here", "en", "s", 1) for i, t in enumerate(good[:12])]
    folder = tmp_path / "documents.parquet"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(folder))
    seen = {}
    docs = spark.read.parquet(str(folder))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert set(seen["language_id"]) == {r[0] for r in rows} - {102, 103}
    assert all("cookie notice" not in r.text for r in seen["line_dedup"].values()) and set(seen["line_dedup"]) == set(seen["language_id"])
    assert 101 not in seen["near_dedup"] and 100 in seen["near_dedup"] and set(range(30)) <= set(seen["near_dedup"])
    assert "[EMAIL]" in seen["pii"][200].text and set(seen["pii"]) == set(seen["near_dedup"]) and seen["pii"][200].n_chars == len(seen["pii"][200].text)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(seen["pii"])


def words_of(seed, n):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefghijklmnop", k=r.randint(3, 8))) for _ in range(n)]


def staged(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    lines = corpus_pipeline.line_stage(spark, docs, "").cache()
    kept = corpus_pipeline.near_duplicate_stage(spark, lines, "")
    return [{r.doc_id: r.text for r in x.collect()} for x in (lines, kept)]


def test_many_copies_leave_one_whole_document(spark):
    exact = "\n".join(" ".join(words_of(i, 12)) for i in range(5))
    body = [" ".join(words_of(100 + i, 12)) for i in range(20)]
    near = ["\n".join([*body, f"edition {i}"]) for i in range(12)]
    pool = ["all rights reserved", "terms of use"]
    mixed = ["\n".join([" ".join(words_of(200 + i, 12)), *pool]) for i in range(12)]
    lines, kept = staged(spark, [exact] * 12 + near + mixed + ["\n".join(pool)])
    assert kept[0] == exact and not set(range(1, 12)) & set(kept)
    assert kept[12] == near[0] and not set(range(13, 24)) & set(kept)
    assert all(lines[24 + i] == mixed[i].split("\n")[0] for i in range(12))
    assert kept[36] == "\n".join(pool)


def test_near_copies_start_at_four_fifths(spark):
    a = words_of(7, 104)
    b = [*a[:95], *words_of(8, 9)]  # 91 of 109 shingles are common
    c = [*a[:90], *words_of(9, 14)]  # 86 of 114
    _, kept = staged(spark, [" ".join(a), " ".join(b), " ".join(c)])
    assert set(kept) == {0, 2}


def test_odd_tables_pass_every_stage(spark, tmp_path):
    fields = "doc_id long, text string, lang string, source string, n_chars long, score double, _row string, kept__ int, n_lines string"
    good = [" ".join(words_of(500 + i, 30)) for i in range(20)]
    rows = [(i, t, "en", "s", len(t), 77.0, "r", 1, "L") for i, t in enumerate(good)]
    rows += [(None, good[0], "en", "s", 1, 77.0, "r", 1, "L"), rows[3], (900, "", "en", "s", 0, 77.0, "r", 1, "L"), (901, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, fields)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == [f.strip().split(" ")[0] for f in fields.split(",")]
        found = docs.collect()
        assert all((r.score, r._row, r.kept__, r.n_lines) == (77.0, "r", 1, "L") for r in found)
        assert sorted(-1 if r.doc_id is None else r.doc_id for r in found) == sorted([-1, 3, *range(20)])
    spark.createDataFrame([], fields).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
