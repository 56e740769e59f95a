"""SentencePiece BPE encoding through a table of last tokens, and decoding.

In a merge-type (BPE) encoding the last token of every prefix is unique: it is the only piece that ends there, encodes to
itself, and is compatible with the last token of the prefix before it (the pair encodes to just these two). So one pass
over an automaton's matches fills a table of last tokens, and walking it backwards gives the ids.

Two pieces are incompatible if a merge over their border comes before both are whole. Each piece's split tree says which
tokens stand at its borders from which merge to which, so a pair needs a look at two short lists, not an encoding.

White space becomes U+2581. No merge crosses two neighbouring characters that no piece holds side by side, so texts are
cut there and at blanks, and the parts are encoded once each while remembered. Characters outside the vocabulary become
their UTF-8 bytes' pieces.

Null and empty texts have no ids; an empty table gives none. Rows are encoded each by itself, so repeated rows and doc_ids
(null ones too) come out once for each row. Long texts and long words take time and memory in proportion. Columns other
than doc_id and text are ignored and never returned, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo

SPACE = "▁"
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Words and parts up to this length are remembered; longer ones are encoded again.
REMEMBERED = 64
#: Words up to this length are encoded many at a time.
SHORT = 32
#: Token numbers from here on stand for characters that no piece covers.
_BARE = 1 << 20
_PAD, _UNKNOWN = 0, 1


class HashTable:
    """Whole numbers by key, with look-ups for whole arrays (open addressing)."""

    def __init__(self, bits: int = 12):
        self.clear(bits)

    def clear(self, bits: int) -> None:
        self.bits, self.used = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        slots = self._slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], np.int32(-1))
        rest = np.flatnonzero((found != keys) & (found >= 0))
        while len(rest):
            slots[rest] = (slots[rest] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slots[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[slots[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that the table does not hold yet."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            held = self.keys >= 0
            keys, values = np.concatenate([self.keys[held], keys]), np.concatenate([self.values[held], values])
            self.clear(max(12, int(4 * len(keys)).bit_length()))
        self.used += len(keys)
        for slot, key, value in zip(self._slots(keys).tolist(), keys.tolist(), values.tolist(), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.values[slot] = key, value


class PrefixTable:
    """An encoder for one BPE model file."""

    def __init__(self, path: str, words: int = 700_000, parts: int = 50_000, pairs: int = 1_000_000):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.ids = {m.id_to_piece(i): i for i in normal}
        self.scores = {m.id_to_piece(i): m.get_score(i) for i in normal}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces with inner white space are not supported")
        if {c for p in self.ids for c in p}.difference(self.ids):
            raise ValueError("a piece has a character that is no piece itself")
        probe = " ﬁ  Å\t½\n"
        self.plain = m.normalize(probe) == SPACE + probe.replace(" ", SPACE)  # the model changes nothing but spaces
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.neighbours = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.splits: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        self.pieces: dict[int, str] = {}
        for piece, number in self.ids.items():
            trace: dict[str, tuple[str, str]] = {}
            if self.merge(piece, trace) == [piece]:  # others can never be a token
                self.automaton.add_word(piece, (len(piece), number))
                self.pieces[number] = piece
                if len(piece) > 1:
                    self.splits[piece] = trace[piece]
        self.automaton.make_automaton()
        self.tied = {s for s, n in Counter(self.scores[p] for p in self.splits).items() if n > 1}
        self.edges = {number: (self._border(p, 1), self._border(p, 0)) for number, p in self.pieces.items()}
        self.compatible = Memo(self._compatible, pairs)
        self.parts = Memo(self._part, parts, REMEMBERED)
        self._automaton_tables()
        self.pairs, self.most_pairs = HashTable(), pairs
        self.words = words
        self.numbers = [str(i) for i in range(m.get_piece_size())]
        self._forget()

    def _automaton_tables(self) -> None:
        """The pieces' automaton as arrays: a class for each character, the states by (state, class), the piece of each state."""
        letters = {c: k for k, c in enumerate(sorted({c for p in self.ids for c in p}), start=_UNKNOWN + 1)}
        self.classes = np.full(0x110000, _UNKNOWN, np.int32)
        self.classes[[ord(c) for c in letters]] = list(letters.values())
        self.classes[0] = _PAD
        self.fan = len(letters) + 2
        states: dict[str, int] = {}
        steps: dict[int, int] = {}
        for piece in self.pieces.values():
            for end in range(1, len(piece) + 1):
                if piece[:end] not in states:
                    states[piece[:end]] = len(states)
                    if end > 1:
                        steps[states[piece[: end - 1]] * self.fan + letters[piece[end - 1]]] = states[piece[:end]]
        self.first = np.full(self.fan, -1, np.int32)
        for c, k in letters.items():
            self.first[k] = states[c]
        self.accepts = np.full(len(states), -1, np.int32)
        for number, piece in self.pieces.items():
            self.accepts[states[piece]] = number
        self.steps = HashTable(int(4 * len(steps)).bit_length())
        self.steps.add(np.array(list(steps), np.int64), np.array(list(steps.values()), np.int32))

    def merge(self, text: str, trace: dict[str, tuple[str, str]] | None = None) -> list[str]:
        """Plain BPE by the best-scored neighbours, leftmost first; it defines which pairs are compatible."""
        parts, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(i: int, j: int) -> None:
            score = self.scores.get(parts[i] + parts[j])
            if score is not None:
                heapq.heappush(heap, (-score, i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= len(parts) or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, ""
            if trace is not None:
                trace[left + right] = left, right
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p]

    def _border(self, piece: str, side: int) -> list[tuple[str, float, float]]:
        """(token, from, to): the tokens at one border of a piece while it is put together, by merge order (minus scores)."""
        out, end = [], math.inf
        while piece in self.splits:
            made = -self.scores[piece]
            out.append((piece, made, end))
            piece, end = self.splits[piece][side], made
        return [*out, (piece, -math.inf, end)]

    def _compatible(self, pair: int) -> bool:
        """Whether no merge over the border of two pieces comes before they are whole."""
        one, two = pair >> 20, pair & 0xFFFFF
        score = self.scores.get
        for a, made_a, end_a in self.edges[one][0]:
            for b, made_b, end_b in self.edges[two][1]:
                s = score(a + b)
                if s is None:
                    continue
                if s in self.tied or made_a >= end_b or made_b >= end_a:
                    if s in self.tied:  # equal scores: only the encoding itself can tell
                        left, right = self.pieces[one], self.pieces[two]
                        return self.merge(left + right) == [left, right]
                    continue
                if -s < end_a and -s <= end_b:
                    return False
        return True

    def tokens(self, part: str) -> list[int]:
        """The ids of a part all of whose characters are pieces, by the table of last tokens."""
        last = [-1] * (len(part) + 1)
        sizes = [0] * (len(part) + 1)
        compatible = self.compatible
        for end, (size, number) in self.automaton.iter(part):  # by end, the longest first
            end += 1
            if last[end] < 0:
                at = end - size
                if not at or compatible[last[at] << 20 | number]:
                    last[end], sizes[end] = number, size
        out, at = [], len(part)
        while at:
            out.append(last[at])
            at -= sizes[at]
        return out[::-1]

    def _part(self, part: str) -> list[int]:
        return self.tokens(part) if len(part) > 1 or part in self.ids else [self.bytes[b] for b in part.encode()]

    def _long(self, word: str) -> list[int]:
        """The ids of a word with a space before it, cut where no merge can cross."""
        whole, neighbours = SPACE + word, self.neighbours
        cuts = [0, *[i for i in range(1, len(whole)) if whole[i - 1 : i + 1] not in neighbours], len(whole)]
        return [i for a, b in zip(cuts, cuts[1:]) for i in self.parts[whole[a:b]]]

    def _fits(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether pairs of tokens are compatible; bare characters are with everything."""
        bare = (one >= _BARE) | (two >= _BARE)
        keys = np.where(bare, 0, one.astype(np.int64) << 20 | two)
        found = self.pairs.get(keys)
        new = np.unique(keys[(found < 0) & ~bare])
        if len(new):
            if self.pairs.used + len(new) > self.most_pairs:
                self.pairs.clear(12)
            self.pairs.add(new, np.array([self._compatible(k) for k in new.tolist()], np.int32))
            found = self.pairs.get(keys)
        return bare | (found == 1)

    def short(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of short words, one after another, and their number for each word, by one table of last tokens for all."""
        count, sizes = len(words), np.array([len(w) + 1 for w in words])
        most = int(sizes.max())
        codes = np.zeros((most + 1, count), np.uint32)
        codes[0] = ord(SPACE)
        codes[1:most] = np.array(words, f"U{max(most - 1, 1)}").view(np.uint32).reshape(count, -1).T[: most - 1]
        classes = self.classes[codes].ravel()
        # the automaton from every start: (start, end, token) of all matches
        at = np.flatnonzero(classes == _UNKNOWN)
        matches = [(at, np.ones(len(at), np.int16), _BARE + codes.ravel()[at].astype(np.int32))]
        at = np.flatnonzero(classes > _UNKNOWN)
        state = self.first[classes[at]]
        size = 1
        while len(at):
            hit = np.flatnonzero(self.accepts[state] >= 0)
            matches.append((at[hit], np.full(len(hit), size, np.int16), self.accepts[state[hit]]))
            after = classes[at + size * count]
            live = after > _UNKNOWN
            at, state = at[live], self.steps.get(state[live].astype(np.int64) * self.fan + after[live])
            at, state = at[state >= 0], state[state >= 0]
            size += 1
        start, size, token = (np.concatenate(x) for x in zip(*matches, strict=True))
        end = (start // count).astype(np.int16) + size
        order = np.argsort(end, kind="stable")
        start, end, token = start[order], end[order], token[order]
        edges = np.searchsorted(end, np.arange(1, most + 2))
        last, before = np.full((most + 1) * count, -1, np.int32), np.zeros((most + 1) * count, np.int64)
        for e in range(1, most + 1):
            a, b = edges[e - 1], edges[e]
            if a == b:
                continue
            here, piece = start[a:b], token[a:b]
            ok = here < count  # at the word's start
            inner = np.flatnonzero(~ok)
            ok[inner] = self._fits(last[here[inner]], piece[inner])
            goal = e * count + here[ok] % count
            last[goal], before[goal] = piece[ok], here[ok]
        # backwards from the ends
        number = np.arange(count)
        place, steps = sizes * count + number, []
        live = number
        while len(live):
            steps.append((live, last[place[live]]))
            place[live] = before[place[live]]
            live = live[place[live] >= count]
        counts = np.bincount(np.concatenate([w for w, _ in steps]), minlength=count)
        ends = np.cumsum(counts) - 1
        out = np.empty(int(counts.sum()), np.int32)
        for back, (w, t) in enumerate(steps):
            out[ends[w] - back] = t
        return self._spelt(out, counts)

    def _spelt(self, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bare characters replaced by their bytes' ids."""
        bare = np.flatnonzero(tokens >= _BARE)
        if not len(bare):
            return tokens, counts
        spelt = {t: [self.bytes[b] for b in chr(t - _BARE).encode()] for t in np.unique(tokens[bare]).tolist()}
        ids = [spelt[t] for t in tokens[bare].tolist()]
        widths = np.ones(len(tokens), np.int64)
        widths[bare] = [len(x) for x in ids]
        out = np.repeat(tokens, widths)
        out[np.repeat(tokens >= _BARE, widths)] = [i for x in ids for i in x]
        return out, np.add.reduceat(widths, np.cumsum(counts) - counts)

    def _forget(self) -> None:
        """Start the memory of words anew: a slot for each word, the place of its ids, and the ids."""
        self.slots: dict[str, int] = {}
        self.places, self.ids_of = np.zeros(1, np.int64), np.empty(0, np.int32)

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.slots]
        if len(self.slots) + len(new) > self.words:
            self._forget()
            new = list(words)
        new.sort(key=len)  # words of like lengths go together
        plain = new[: bisect_left(new, SHORT, key=len)]
        other = new[len(plain) :] + [w for w in plain if "\0" in w]
        if len(plain) + len(other) > len(new):
            plain = [w for w in plain if "\0" not in w]
        ids, counts = [self.ids_of], [np.empty(0, np.int64)]
        for at in range(0, len(plain), 8192):
            found = self.short(plain[at : at + 8192])
            ids.append(found[0]), counts.append(found[1])
        long = [self._long(w) for w in other]
        ids.append(np.array([i for x in long for i in x], np.int32)), counts.append(np.array([len(x) for x in long], np.int64))
        self.slots.update(zip([*plain, *other], range(len(self.slots), len(self.slots) + len(new)), strict=True))
        self.ids_of = np.concatenate(ids)
        self.places = np.concatenate([self.places, self.places[-1] + np.cumsum(np.concatenate(counts))])

    def split(self, text: str) -> list[str]:
        """The words of a text, each without the space that it begins with."""
        if not text:
            return []
        if self.plain:
            found = text.split(" ")
            if "" not in found and SPACE not in text:
                return found
            text = SPACE + text.replace(" ", SPACE)
        else:
            text = self.model.normalize(text)
            if not text.startswith(SPACE):
                raise ValueError("models without a leading space are not supported")
        return [x[1:] for x in _SEGMENT.findall(text)]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        words = [self.split(t) for t in texts]
        self._learn({w for x in words for w in x})
        slots = np.fromiter(map(self.slots.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        first, counts = self.places[slots], self.places[slots + 1] - self.places[slots]
        ends = np.cumsum(counts)
        ids = self.ids_of[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - counts), counts)]
        edges = np.concatenate([[0], ends])[np.cumsum([0, *map(len, words)])].tolist()
        return [ids[a:b].tolist() for a, b in zip(edges, edges[1:])]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


_tables: dict[str, PrefixTable] = {}
#: Texts encoded together.
TOGETHER = 512


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[PrefixTable, pa.Array, list[list[int]]]]:
    table = _tables.get(path) or _tables.setdefault(path, PrefixTable(path))
    for whole in batches:
        for at in range(0, whole.num_rows, TOGETHER):
            batch = whole.slice(at, TOGETHER)
            yield table, batch.column(0), table.encode_batch([t or "" for t in batch.column(1).to_pylist()])


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Per row: doc_id, ids, decoded."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, keys, ids in _encoded(batches, path):
            yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.list_(pa.int32())), pa.array(map(table.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; ids and decoded texts stay inside the tasks."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, keys, ids in _encoded(batches, path):
            name = table.numbers.__getitem__
            listed = [hashlib.sha256(",".join(map(name, x)).encode()).hexdigest() for x in ids]
            decoded = [hashlib.sha256(table.decode(x).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([keys, pa.array(map(len, ids), pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
