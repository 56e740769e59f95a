"""Language identification by unigram pieces with the segmentation summed out.

For each language a probability is learnt for every piece of a fixed public vocabulary. A word's probability is the sum
over all ways to cut it into pieces, found by a forward recursion; a text's is the product over its words (runs of
letters, lower-cased, each with a leading word mark). The probabilities come from a few rounds of expectation
maximisation: expected piece counts by forward and backward sums, added up over the training texts in Spark; only the
table pieces x languages, bounded by the vocabulary, reaches the driver.

The score is the posterior under equal priors with the log-likelihoods averaged per word and weighted by `sharpness`, so it
does not saturate with length. A null or empty text, or one without letters, is `und` with score 0. Between equal
posteriors the language that sorts first wins. Training rows with null text or null lang are ignored; without any, every
text is `und`; an empty table stays empty. Repeated rows are scored each by itself. Long texts take time in proportion, and
so do long words, which are never cut. Other columns are never looked at; those named lang_pred or score give way.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .minhash import mix

MARK = "▁"
_WORD = re.compile(r"[^\W\d_]+")
#: Words of more letters are summed in logarithms, letter by letter, so that nothing underflows.
LONG = 24
#: Letters of a long word whose pieces are looked up together.
STRETCH = 4096
#: The classifier is fitted on about so many labelled texts of each language, chosen by a hash of the text; every text is scored.
SAMPLE_PER_LANGUAGE = 1500
ROUNDS = 3
_LOST = 1e-7  # probability of a letter that no piece covers


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _piece_hash(piece: str) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for code in mix(np.frombuffer(piece.encode("utf-32-le"), np.uint32).astype(np.uint64)):
        h = h * _BASE + code
    return h[0]


def vocabulary(path: str | None = None) -> dict[str, int]:
    """The lower-case letter pieces of the public vocabulary, numbered; a leading word mark is kept."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}
    fit = sorted(p for p in pieces if p == MARK or re.fullmatch(r"[^\W\d_]+", p.removeprefix(MARK)) and p == p.lower())
    return {p: i for i, p in enumerate(fit)}


def words(text: str) -> Counter:
    """Counts of the words of a text."""
    out: Counter = Counter()
    for w, n in Counter(_WORD.findall(text.lower())).items():
        if not w.isalpha():  # numerals such as fractions are no letters
            w = "".join(filter(str.isalpha, w))
            if not w:
                continue
        out[MARK + w] += n
    return out


class Lattice:
    """Forward and backward sums over the segmentations of words, for all languages at once."""

    def __init__(self, pieces: dict[str, int], table: np.ndarray):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        hashes = np.array([_piece_hash(p) for p in pieces] or [0], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], np.array(list(pieces.values()) or [-2], np.int32)[order]
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces have one hash")
        self.table = np.vstack([table, np.full((1, table.shape[1]), _LOST)])  # the last row: no piece

    def edges(self, batch: list[str]) -> np.ndarray:
        """(words, ends, lengths) piece numbers of words of one length; -1 is a lone letter without a piece, -2 nothing."""
        n, most = len(batch[0]), min(len(batch[0]), self.longest)
        letters = mix(np.frombuffer("".join(batch).encode("utf-32-le"), np.uint32).astype(np.uint64)).reshape(len(batch), n)
        out = np.full((len(batch), n, most), -2, np.int32)
        hashed = np.zeros((len(batch), n + 1), np.uint64)
        for size in range(1, most + 1):  # polynomial hashes of all substrings of this size
            hashed = hashed[:, : n - size + 1] * _BASE + letters[:, size - 1 :]
            at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
            found = self.hashes[at] == hashed
            out[:, size - 1 :, size - 1] = np.where(found, self.numbers[at], -1 if size == 1 else -2)
        return out

    def forward(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """alpha (words, n + 1, languages), and the edges' probabilities (words, n, lengths, languages)."""
        p = self.table[edges] * (edges > -2)[..., None]
        count, n, most, languages = p.shape
        alpha = np.zeros((count, n + 1, languages))
        alpha[:, 0] = 1
        for end in range(n):
            for size in range(1, min(end + 1, most) + 1):
                alpha[:, end + 1] += alpha[:, end + 1 - size] * p[:, end, size - 1]
        return alpha, p

    def score(self, batch: list[str]) -> np.ndarray:
        """Log-probabilities (words, languages) of words of any lengths."""
        out = np.empty((len(batch), self.table.shape[1]))
        for rows, part in _by_length(batch):
            if len(part[0]) > LONG:
                for row, word in zip(rows, part, strict=True):
                    out[row] = self.long_forward(word)[-1]
            else:
                out[rows] = np.log(self.forward(self.edges(part))[0][:, -1])
        return out

    def stretches(self, word: str) -> Iterator[tuple[int, np.ndarray]]:
        """(first end, pieces by end and length) of a long word, some ends at a time."""
        for at in range(0, len(word), STRETCH):
            low = max(0, at - self.longest + 1)
            found = self.edges([word[low : at + STRETCH]])[0][at - low :]
            full = np.full((len(found), self.longest), -2, np.int32)
            full[:, : found.shape[1]] = found
            yield at, full

    def _logs(self, edges: np.ndarray) -> np.ndarray:
        return np.where((edges > -2)[..., None], np.log(self.table)[edges], -np.inf)

    def long_forward(self, word: str) -> np.ndarray:
        """(letters + 1, languages) logarithms of the sums over all segmentations of each prefix."""
        out = np.full((len(word) + 1, self.table.shape[1]), -np.inf)
        out[0] = 0
        for at, edges in self.stretches(word):
            for end, p in enumerate(self._logs(edges), start=at):
                most = min(end + 1, self.longest)
                out[end + 1] = np.logaddexp.reduce(out[end + 1 - most : end + 1][::-1] + p[:most], axis=0)
        return out

    def _expect_long(self, word: str, weight: float, language: int, out: np.ndarray) -> None:
        alpha = self.long_forward(word)[:, language]
        beta = np.full(len(word) + 1, -np.inf)
        beta[-1] = 0
        parts = list(self.stretches(word))
        for at, edges in reversed(parts):
            p = self._logs(edges)[..., language]
            for end in range(at + len(p) - 1, at - 1, -1):
                most = min(end + 1, self.longest)
                low = end + 1 - most
                beta[low : end + 1] = np.logaddexp(beta[low : end + 1], (p[end - at, :most] + beta[end + 1])[::-1])
        for at, edges in parts:
            p = self._logs(edges)[..., language]
            ends, sizes = np.nonzero(edges >= 0)
            use = np.exp(alpha[at + ends - sizes] + p[ends, sizes] + beta[at + ends + 1] - alpha[-1])
            np.add.at(out, edges[ends, sizes], weight * use)

    def expect(self, batch: list[str], weights: np.ndarray, language: int) -> np.ndarray:
        """Expected counts of each piece under one language."""
        out = np.zeros(len(self.pieces) + 1)
        for rows, part in _by_length(batch):
            if len(part[0]) > LONG:
                for row, word in zip(rows, part, strict=True):
                    self._expect_long(word, float(weights[row]), language, out)
                continue
            edges = self.edges(part)
            alpha, p = self.forward(edges)
            alpha, p = alpha[..., language], p[..., language]
            count, n, most = p.shape
            beta = np.zeros((count, n + 1))
            beta[:, n] = 1
            for end in range(n - 1, -1, -1):
                for size in range(1, min(end + 1, most) + 1):
                    beta[:, end + 1 - size] += p[:, end, size - 1] * beta[:, end + 1]
            scale = weights[rows] / alpha[:, -1]
            for size in range(1, most + 1):
                use = alpha[:, : n + 1 - size] * p[:, size - 1 :, size - 1] * beta[:, size:] * scale[:, None]
                which = edges[:, size - 1 :, size - 1]
                ok = which >= 0
                np.add.at(out, which[ok], use[ok])
        return out[:-1]


def _by_length(batch: list[str], most: int = 4096) -> Iterator[tuple[np.ndarray, list[str]]]:
    groups = defaultdict(list)
    for i, w in enumerate(batch):
        groups[len(w)].append(i)
    for rows in groups.values():
        for at in range(0, len(rows), most):
            part = rows[at : at + most]
            yield np.array(part), [batch[i] for i in part]


def training_sample(docs: DataFrame, train: Column, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[DataFrame, list[str]]:
    """About `per_language` different labelled texts of each language, drawn by a hash of the text, and the languages.

    Copies of a text count once, so a large group of them neither floods nor empties a language's sample.
    """
    labelled = docs.filter(train & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, per_language / max(n, 1)))) for k, n in sizes.items()]) if sizes else F.lit(0.0)
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1_000_000.0
    return labelled.filter(draw < share).dropDuplicates(["lang", "text"]), sorted(sizes)


def fit(sample: DataFrame, languages: list[str], pieces: dict[str, int], rounds: int = ROUNDS) -> np.ndarray:
    """(pieces, languages) probabilities."""
    if not languages:
        return np.zeros((len(pieces), 0))
    spark = sample.sparkSession
    table = np.full((len(pieces), len(languages)), 1.0 / len(pieces))
    at = {k: i for i, k in enumerate(languages)}
    bags = _bags(sample).persist()
    for _ in range(rounds):
        model = spark.sparkContext.broadcast((pieces, table))

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(*model.value)
            sums = defaultdict(lambda: np.zeros(len(lattice.pieces)))
            for batch in batches:
                for lang in set(batch.column(0).to_pylist()):
                    rows = [(w, n) for k, w, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) if k == lang]
                    sums[lang] += lattice.expect([w for w, _ in rows], np.array([float(n) for _, n in rows]), at[lang])
            for lang, s in sums.items():
                used = np.flatnonzero(s)
                yield pa.RecordBatch.from_arrays([pa.array([at[lang]] * len(used), pa.int32()), pa.array(used.astype(np.int32)), pa.array(s[used])], ["lang", "piece", "n"])

        counts = bags.mapInArrow(run, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        found = np.zeros_like(table)
        found[counts.piece.to_numpy(), counts.lang.to_numpy()] = counts.n.to_numpy()
        pooled = (found / np.maximum(found.sum(axis=0), 1)).mean(axis=1, keepdims=True)
        smooth = 200.0 * (0.5 * pooled + 0.5 / len(pieces))  # pseudo-counts
        table = (found + smooth) / (found + smooth).sum(axis=0)
    bags.unpersist()
    return table


def _bags(sample: DataFrame) -> DataFrame:
    """(lang, word, n) of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[lang].update(words(text))
        for lang, bag in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bag)), pa.array(list(bag)), pa.array(list(bag.values()), pa.int64())], ["lang", "word", "n"])

    return sample.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Scorer:
    """Word scores, remembered within bounded memory."""

    def __init__(self, pieces: dict[str, int], table: np.ndarray, languages: list[str], sharpness: float, limit: int = 400_000):
        self.lattice, self.languages, self.sharpness = Lattice(pieces, table), languages, sharpness
        self.at: dict[str, int] = {}
        self.limit = limit
        self.scores = np.empty((1 << 12, len(languages)))

    def learn(self, bags: list[Counter]) -> None:
        new = list(dict.fromkeys(w for bag in bags for w in bag if w not in self.at))
        if not new:
            return
        if len(self.at) + len(new) > self.limit:
            self.at = {}
            new = list(dict.fromkeys(w for bag in bags for w in bag))
        need = len(self.at) + len(new)
        if need > len(self.scores):
            self.scores = np.concatenate([self.scores, np.empty((max(need, 2 * len(self.scores)) - len(self.scores), len(self.languages)))])
        base = len(self.at)
        self.scores[base:need] = self.lattice.score(new)
        self.at.update(zip(new, range(base, need), strict=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        for at in range(0, len(texts), 256):
            bags = [words(t) if t else Counter() for t in texts[at : at + 256]]
            if self.languages:
                self.learn(bags)
            for bag in bags:
                if not bag or not self.languages:
                    out.append(("und", 0.0))
                    continue
                n = np.fromiter(bag.values(), np.float64, len(bag))
                total = n @ self.scores[np.fromiter(map(self.at.__getitem__, bag), np.int64, len(bag))]
                mean = total / n.sum()
                best = int(np.argmax(mean))
                out.append((self.languages[best], float(1 / np.exp(self.sharpness * (mean - mean[best])).sum())))
        return out


_scorers: dict[str, Scorer] = {}


def identify(docs: DataFrame, train: Column, per_language: int = SAMPLE_PER_LANGUAGE, vocabulary_path: str | None = None, sharpness: float = 4.0) -> DataFrame:
    """`docs` with lang_pred and score added; the model is learnt from the rows where `train` holds."""
    spark = docs.sparkSession
    pieces = vocabulary(vocabulary_path)
    sample, languages = training_sample(docs, train, per_language)
    table = fit(sample, languages, pieces)
    model = spark.sparkContext.broadcast((pieces, table, languages, sharpness))
    key = f"{spark.sparkContext.applicationId}-{id(model)}-{math.fsum(table.ravel())}"
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = names.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(*model.value)
        for batch in batches:
            found = _scorers[key].predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], [*names, "lang_pred", "score"])

    return docs.select(*names).mapInArrow(run, f"{fields}, lang_pred string, score double")
