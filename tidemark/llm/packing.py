"""Best-fit packing of token sequences, with lower bounds that certify each partition's bin count.

A document's token ids (and one end id) are cut into pieces of at most `capacity` tokens; only documents longer than that
are cut, and the first piece takes what is left over. Pieces are dealt at random to packing partitions of a bounded token
count. Each runs best-fit decreasing and compares its bins with dual-feasible-function lower bounds. Where the bound is
met, the partition is certified and its bins stand. Partitions with a gap keep their full bins, exchange the documents of
the others in a new deal, and run again, for a few rounds.

Null, empty: a null or empty text is the end id alone, and an empty table gives no rows. Repeated rows and doc_ids are
packed each by itself; a long text becomes many full pieces. Of bins with equal room the one filled last is used, and equal
lengths keep their order. Columns other than doc_id and text are ignored and never returned, whatever their names.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, settle

CAPACITY = 1024
#: Tokens dealt to one packing partition: about 8000 bins, so what the last bin of each wastes is about 0.01 %.
DEAL_TOKENS = 8_000_000
ROUNDS = 3
#: More bins than one deal can need; sequence numbers are (deal, bin, round) in one integer.
_DEAL_BINS = 1 << 24
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_PUNCTUATION = "".join(set(string.punctuation) - {"'"})
#: White space other than blank and newline.
_ODD_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


class ByteBpe:
    """Token ids as little-endian 32-bit bytes, found by the tokenizers library and remembered by chunk.

    The vocabulary's pre-tokenisation always starts a token where white space follows something else, and between a
    letter and ASCII punctuation other than the apostrophe; chunks cut there have the same ids alone as in the text.
    """

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: array("I", [i]).tobytes() for i, t in added.items()}
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that take their surroundings are not supported")
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokenizer.encode_special_tokens = True  # chunks hold none; their literals in a text are cut out before
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, chunks: list[str]) -> None:
        """Words of Latin letters, which are one pre-token each, go to the library's BPE model itself; the rest through it all."""
        merge, rest = self.tokenizer.model.tokenize, []
        for c in chunks:
            if (c.isalpha() or c[0] == " " and c[1:].isalpha()) and max(c) < "\u0250":
                self.known[c] = array("I", [t.id for t in merge(c.encode().decode("latin-1").translate(_BYTE_LETTERS))]).tobytes()
            else:
                rest.append(c)
        found = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        self.known.update((c, array("I", e.ids).tobytes()) for c, e in zip(rest, found, strict=True))

    def _learn(self, chunks: set[str]) -> None:
        """Make all chunks known; beyond the limit the known ones become the old generation, from which used ones return."""
        if len(self.known) > self.limit:
            self.known, self.old = {}, self.known
        new, parts = [], {}
        for c in chunks.difference(self.known):
            if c in self.old:
                self.known[c] = self.old[c]
                continue
            core = c.rstrip(_PUNCTUATION)
            if len(core) < len(c) and core and core[-1].isalpha():
                parts[c] = (core, c[len(core) :])
            else:
                new.append(c)
        halves = {h for pair in parts.values() for h in pair}.difference(self.known, new)
        if new or halves:
            self._encode([*new, *halves])
        for c, (core, tail) in parts.items():
            self.known[c] = self.known[core] + self.known[tail]

    def _cut(self, text: str) -> list[str]:
        """Chunks of a text; the literal of an added token is a chunk of its own, and what lies around it is cut by itself."""
        if not any(s in text for s in self.special):
            return _chunks(text)
        self.known.update(self.special)
        return [c for k, part in enumerate(self.at_special.split(text)) for c in ([part] if k % 2 else _chunks(part))]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self._cut(t) for t in texts]
        self._learn({c for chunks in cut for c in chunks})
        self.known.update(self.special)
        get = self.known.__getitem__
        return [b"".join(map(get, chunks)) for chunks in cut]


def _chunks(text: str) -> list[str]:
    """The text cut before each blank or newline that follows something else than white space."""
    if not text:
        return []
    if not any(c in text for c in _ODD_SPACE):
        parts = text.replace("\n", " \n").split(" ")
        if "" not in parts and "\n" not in parts:
            return [parts[0], *[p if p[0] == "\n" else " " + p for p in parts[1:]]]
    return _CUT.split(text)


_encoders: dict[str, ByteBpe] = {}


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = 2) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    end = np.array([end_id], np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoders.get(path) or _encoders.setdefault(path, ByteBpe(path))
        for batch in batches:
            rows = []
            docs_, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            found = (x for at in range(0, len(texts), 256) for x in coder.encode(texts[at : at + 256]))
            for doc, ids in zip(docs_, found, strict=True):
                ids += end
                n = len(ids) // 4
                at = n % capacity or capacity
                edges = [0, *range(min(at, n), n + 1, capacity)]
                for k in range(len(edges) - 1):
                    rows.append((doc, k, edges[k], edges[k + 1] - edges[k], zlib.crc32(ids[4 * edges[k] : 4 * edges[k + 1]])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY, times: np.ndarray | None = None) -> int:
    """The best of the bounds by dual feasible functions: two classic families and the plain sum; `times` counts each length.

    Each function u keeps sum(u(x)) <= 1 for any lengths that fit one bin, so the rounded-up total of u is a lower bound.
    """
    size, count = np.unique(lengths, return_counts=True) if times is None else (lengths, times)
    if not len(size):
        return 0
    best = -(-int((size * count).sum()) // capacity)
    for k in range(1, 21):  # u_k: rounds (k + 1) x / C down to multiples of 1 / k, exact where it is whole
        scaled = (k + 1) * size
        whole = scaled % capacity == 0
        value = np.where(whole, size * k, (scaled // capacity) * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((value * count).sum()) // (k * capacity)))
    half = np.unique(np.concatenate([size[size <= capacity // 2], [0]]))
    for cut in half:  # lengths over C - cut count as 1, those under cut as 0
        value = np.where(size > capacity - cut, capacity, np.where(size >= cut, size, 0))
        best = max(best, -(-int((value * count).sum()) // capacity))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length, and the number of bins."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free room
    rooms: list[int] = []  # the rooms that have bins, ascending
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        at = bisect_left(rooms, need)
        if at < len(rooms):
            room = rooms[at]
            b = stacks[room].pop()
            if not stacks[room]:
                rooms.pop(at)
        else:
            b, room, made = made, capacity, made + 1
        bins[i], offsets[i] = b, capacity - room
        left = room - need
        if left:
            if not stacks[left]:
                insort(rooms, left)
            stacks[left].append(b)
    return bins, offsets, made


def _pack(capacity: int):
    def run(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        lengths = frame.length.to_numpy()
        bins, offsets, made = best_fit_decreasing(lengths, capacity)
        filled = np.bincount(bins, lengths, made)
        bound = lower_bound(lengths, capacity)
        return pd.DataFrame({"row": frame.row, "length": lengths, "deal": keys[0], "bin": bins, "offset": offsets, "stands": (made == bound) | (filled[bins] == capacity), "bins": made, "bound": bound})

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, deal_tokens: int = DEAL_TOKENS, rounds: int = ROUNDS) -> DataFrame:
    """`pieces` (with a column length, 1 to capacity) with sequence_id, offset, bins and bound added; each sequence is gapless from 0.

    bins and bound are the bins and the lower bound of the packing partition that the sequence stands in; where they are
    equal, no packing of that partition's pieces needs fewer. A full piece is its own partition (1 and 1).
    """
    spark = pieces.sparkSession
    table = settle(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = table.filter(F.col("length") == capacity).select("row", (F.col("row") * (rounds + 1)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(1).cast("long").alias("bins"), F.lit(1).cast("long").alias("bound"))
    rest = table.filter(F.col("length") < capacity).select("row", "length")
    placed = [whole]
    for k in range(rounds):
        tokens = rest.agg(F.sum("length")).first()[0] or 0
        if not tokens:
            break
        last = k == rounds - 1
        deals = max(1 if last else 2, round(tokens / deal_tokens))
        dealt = rest.withColumn("deal", F.pmod(F.xxhash64("row", F.lit(k)), F.lit(deals)))
        packed = settle(dealt.groupBy("deal").applyInPandas(_pack(capacity), "row long, length long, deal long, bin long, offset long, stands boolean, bins long, bound long"), "packed")
        done = packed if last else packed.filter("stands")
        placed.append(done.select("row", ((F.col("deal") * _DEAL_BINS + F.col("bin")) * (rounds + 1) + (k + 1)).alias("sequence_id"), "offset", "bins", "bound"))
        if last:
            break
        rest = packed.filter("not stands").select("row", "length")
    every = placed[0]
    for part in placed[1:]:
        every = every.union(part)
    return table.join(every, "row").drop("row")


def bound_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences used and the lower bound of the whole table, from its length counts (at most `capacity` rows)."""
    counts = packed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    bound = lower_bound(np.array([r.length for r in counts], np.int64), capacity, np.array([r.n for r in counts], np.int64))
    return packed.agg(F.count_distinct("sequence_id").alias("sequences")).withColumn("lower_bound", F.lit(bound))
