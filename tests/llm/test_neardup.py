import itertools
import random

import pytest

from tidemark.llm import minhash as M
from tidemark.llm import neardup
from tidemark.llm.components import connected_components
from tidemark.llm.neardup import near_duplicates

SCHEMA = "doc_id long, text string, n_shingles string, bkey int"  # two columns with clashing names


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def expected(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in itertools.combinations(sets, 2):
        if s and t and 100 * len(s & t) >= 85 * len(s | t):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus():
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(6):
        text = r.choices(words, k=120)
        for copy in range(30 if base == 0 else 4):
            new = list(text)
            for _ in range(copy % 4):
                new[r.randrange(len(new))] = r.choice(words)
            rows.append(" ".join(new))
    rows += rows[:5] + ["Ab c", "aB  C", "", None, " \t\n", "one two three four", "x " * 3000, "café É a b c", "café é a b c"]
    r.shuffle(rows)
    return list(enumerate(rows, start=10))


@pytest.mark.parametrize("blocks", [(256, 512), (3, 5)])
def test_components_match_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(neardup, "OWN_BLOCK", blocks[0])
    monkeypatch.setattr(neardup, "ALL_BLOCK", blocks[1])
    rows = corpus()
    got = near_duplicates(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)).collect()
    want = expected(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_nulls_repeats_and_empty_table(spark):
    rows = [(None, "a b c d e f", "x", 1), (5, "a b c d e f", "x", 1), (5, "a b c d e f", "x", 1), (6, "A B C D E F", "x", 1)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (5, 5, True), (5, 5, True), (6, 5, False)]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_id_with_several_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a, "x", 1), (5, b, "x", 1), (6, b + " more", "x", 1), (3, a + " more", "x", 1)]
    for order in itertools.permutations(rows):
        got = near_duplicates(spark.createDataFrame(list(order), SCHEMA)).collect()
        assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(5, 3, False), (6, 3, False), (3, 3, True)}
        if order[0][0] == 5 and order[1][0] == 6:
            break


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(0, 20)] + [(100, 101), (7, 7)]
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100: 100, 101: 100}


def test_odd_sketch_keeps_pairs_at_the_threshold():
    import numpy as np

    rng = np.random.default_rng(1)
    most = M.most_flips(0.85)
    for _ in range(200):
        common = rng.integers(0, 2**63, 850, dtype=np.uint64)
        a = np.concatenate([common, rng.integers(0, 2**63, 75, dtype=np.uint64)])
        b = np.concatenate([common, rng.integers(0, 2**63, 75, dtype=np.uint64)])
        x, y = (np.frombuffer(M.odd_sketch(M.signature(s)), np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= most


def test_tasks_hold_few_texts_and_words_at_a_time(spark):
    """Workers live on through the steps of a pipeline, so what each of them keeps adds up in an executor."""
    import pyarrow as pa

    from tidemark.llm import common, minhash

    def run(batch):
        return pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    sizes = [r.n for r in common.map_batches(spark.range(5000).coalesce(1), run, "n long").collect()]
    assert max(sizes) <= common.ROWS and sum(sizes) == 5000
    assert minhash._words.limit <= 60_000
