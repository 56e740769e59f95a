"""Numeric core of near-duplicate search: shingle hashes, MinHash, bands and odd sketches."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import Memo

SHINGLE = 5
ROWS, BANDS = 5, 25
SAMPLES = ROWS * BANDS
#: Bits of an odd sketch.
BITS = 512
_RNG = np.random.default_rng(20240117)
_A = _RNG.integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_W = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = _RNG.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 2048
#: Workers live on through later steps and keep this: about 20 MB each.
_words: Memo = Memo(xxhash.xxh3_64_intdigest, 60_000, 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; fewer words than `width` make one; no words, none."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    if n < width:
        return mix(np.array([(h * _W[:n]).sum() + np.uint64(n)], np.uint64))
    acc = h[: n - width + 1] * _W[0]
    for i in range(1, width):
        acc += h[i : n - width + 1 + i] * _W[i]
    return np.unique(mix(acc))


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash samples of a set that is not empty."""
    best = None
    for at in range(0, len(shingles), _BLOCK):
        part = shingles[at : at + _BLOCK]
        low = ((part[None, :] ^ _B[:, None]) * _A[:, None]).min(axis=1)
        best = low if best is None else np.minimum(best, low)
    return best


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of samples."""
    mixed = (mix(sig).reshape(BANDS, ROWS) * _R).sum(axis=1, dtype=np.uint64)
    return mix(mixed + np.arange(BANDS, dtype=np.uint64))


def odd_sketch(sig: np.ndarray) -> bytes:
    """Each sample flips one bit: equal samples of two documents cancel in the XOR of their sketches."""
    at = mix(sig + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS.bit_length() + 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def most_flips(similarity: float, margin: float = 0.2) -> int:
    """The largest XOR population count that a pair of at least `similarity` can plausibly show.

    An odd sketch estimates J from the count c by 1 + BITS / (4 * SAMPLES) * ln(1 - 2c / BITS). A pair at the threshold
    differs in Binomial(SAMPLES, 1 - J) samples; the margin of 0.2 lies over six standard deviations away.
    """
    tosses = 2 * (1 - (similarity - margin)) * SAMPLES
    return int(np.ceil(BITS / 2 * (1 - (1 - 2 / BITS) ** tosses)))
