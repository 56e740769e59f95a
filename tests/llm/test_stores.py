import hashlib
import random
import zlib

import numpy as np
import public_tokenizers

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, size string, shard string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)


def texts(n=150, seed=8):
    r = random.Random(seed)
    parts = ["the", " ", "\n", "Word", "don't", "word.", " x1", "éß", "\U0001f600", "  ", "\t", "2024", "!?", "あい", "▁", "<s>", "\r\n", "a" * 30, "<|endoftext|>"]
    return ["".join(r.choices(parts, k=r.randint(0, 60))) for _ in range(n)] + [None, "", " ", "z" * 20_000, "word " * 3000]


# packing


def test_packing_is_whole_and_exact(spark):
    from tokenizers import Tokenizer

    from tidemark.llm.packing import bound_report, pack, token_pieces

    rows = texts()
    out = pack(token_pieces(frame(spark, rows)))
    got = out.collect()
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in enumerate(rows):
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 2], np.uint32)
        pieces = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and sum(r.length for r in pieces) == len(ids)
        assert all(r.length == 1024 for r in pieces[1:])
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    report = bound_report(out).first()
    assert report.lower_bound <= report.sequences <= report.lower_bound + 1
    assert all(r.bound <= r.bins for r in got)
    assert pack(token_pieces(frame(spark, []))).count() == 0


def test_gaps_exchange_documents(spark):
    from tidemark.llm.packing import pack

    r = random.Random(9)
    rows = [(i, r.randint(250, 700)) for i in range(400)]
    out = pack(spark.createDataFrame(rows, "doc_id long, length long"), deal_tokens=4_000).collect()
    assert sorted((x.doc_id, x.length) for x in out) == sorted(rows)
    by = {}
    for x in out:
        by.setdefault(x.sequence_id, []).append(x)
    assert all(sum(x.length for x in b) <= 1024 for b in by.values())
    once = pack(spark.createDataFrame(rows, "doc_id long, length long"), deal_tokens=4_000, rounds=1).collect()
    assert len(by) < len({x.sequence_id for x in once})  # exchange and rerun save bins


def test_lower_bounds_hold():
    from tidemark.llm.packing import best_fit_decreasing, lower_bound

    r = np.random.default_rng(1)
    for _ in range(50):
        lengths = r.integers(1, 1025, r.integers(1, 60))
        assert lower_bound(lengths) <= best_fit_decreasing(lengths)[2]
    assert lower_bound(np.array([600] * 5)) == 5 and lower_bound(np.array([400] * 5)) == 3


# sentencepiece


def test_sentencepiece_is_the_library(spark):
    import sentencepiece

    from tidemark.llm.spm import digest_documents, encode_documents

    rows = texts()
    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in digest_documents(frame(spark, rows)).collect():
        ids = m.encode(rows[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(m.decode(ids).encode()).hexdigest()
    assert digest_documents(frame(spark, [])).count() == 0 and encode_documents(frame(spark, [])).count() == 0
    one = encode_documents(frame(spark, ["Hello  wörld"])).first()
    assert one.ids == m.encode("Hello  wörld") and one.decoded == "Hello  wörld"


def test_pair_rule_is_the_encoding():
    from tidemark.llm.spm import HashTable, PrefixTable

    table = PrefixTable(public_tokenizers.path("piece_bpe_32k.model"), words=200, pairs=5000)
    r = random.Random(3)
    tokens = list(table.pieces)
    for _ in range(3000):
        a, b = r.choice(tokens), r.choice(tokens)
        pair = [table.pieces[a], table.pieces[b]]
        assert table._compatible(a << 20 | b) == (table.merge("".join(pair)) == pair)
    found = table.encode_batch([t or "" for t in texts(400, 9)])  # with memories that overflow
    assert found == table.model.encode([t or "" for t in texts(400, 9)])
    numbers = HashTable()
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 50, 9000))
    for at in range(0, len(keys), 1000):
        numbers.add(keys[at : at + 1000], np.arange(at, min(at + 1000, len(keys)), dtype=np.int32))
    assert (numbers.get(keys) == np.arange(len(keys))).all() and (numbers.get(keys + 1)[~np.isin(keys + 1, keys)] == -1).all()


# media


def test_avi_round_trip(spark):
    from tidemark.llm import media

    rows = [*texts(40), "ÿ" * 700]
    stored = media.encode_media(frame(spark, rows))
    got = {r.doc_id: r for r in media.media_digests(stored).collect()}
    for i, t in enumerate(rows):
        raw = (t or "").encode()
        whole = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
    shots = media.clips(stored).groupBy("doc_id").agg(F.sum("frames").alias("n"), F.count(F.lit(1)).alias("k")).collect()
    for r in shots:
        assert got[r.doc_id].feature.startswith(f"frames={r.n};shots={r.k};") and r.n * 576 == got[r.doc_id].payload_bytes
    assert media.media_digests(media.encode_media(frame(spark, []))).count() == 0


def test_every_difference_survives_and_cuts_are_found():
    from tidemark.llm import media

    r = np.random.default_rng(2)
    frames = r.integers(0, 256, (20, 24, 24), dtype=np.uint8)
    frames[0, ::2], frames[0, 1::2] = 0, 255
    data = media.write_avi(media.encode_frames(frames))
    back, fps = media.read_avi(data)
    assert (media.decode_frames(back) == frames).all() and abs(fps - media.FPS) < 0.1
    scene = np.concatenate([r.integers(0, 40, (10, 24, 24)), r.integers(180, 220, (7, 24, 24))]).astype(np.uint8)
    assert media.cuts(scene) == [10]


# warc


def test_warc_round_trip(spark):
    from tidemark.llm.warc import round_trip

    big = "<p>" + "x" * 1500
    rows = [(1, "http://a/ b", big), (2, None, big), (7, "http://c", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (6, "u", "é\r\n\r\n" * 900), (7, "http://c", big)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, path string")
    got = round_trip(pages, archive_bytes=3000).collect()
    html = lambda i: (dict((a, c) for a, _, c in rows)[i] or "").encode()
    assert sorted(r.page_id or 0 for r in got) == sorted(r[0] or 0 for r in rows)
    for r in got:
        assert r.payload_bytes == len(html(r.page_id)) and r.payload_digest == hashlib.sha1(html(r.page_id)).hexdigest()
        again = r.page_id in (None, 1, 2)
        assert (r.record_type, r.refers_to) == (("revisit", 7) if again else ("response", None))
    assert round_trip(pages.limit(0)).count() == 0


# sharding


def test_shards(spark):
    from tidemark.llm.sharding import kd_shards

    r = random.Random(11)
    rows = ["t" * r.randint(1, 50) + str(i) for i in range(600)] + ["copy " * 10] * 300 + [None, ""]
    got = kd_shards(frame(spark, rows)).collect()
    sizes, slots, homes = {}, {}, {}
    for x in got:
        raw = (rows[x.doc_id] or "").encode()
        assert (x.size, x.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        sizes[x.shard] = sizes.get(x.shard, 0) + x.size
        slots.setdefault(x.shard, []).append(x.slot)
        homes.setdefault(raw, set()).add(x.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in homes.values())
    copies = homes[("copy " * 10).encode()].pop()
    rest = [s for k, s in sizes.items() if k != copies]
    assert len(rest) == 7 and max(rest) < 1.05 * min(rest)
    assert kd_shards(frame(spark, [])).count() == 0 and kd_shards(frame(spark, ["a", "a"])).select("shard").distinct().count() == 1
