"""Motion-JPEG in AVI, losslessly: text bytes as grey frames, a RIFF index, intra decoding and shot detection.

A payload becomes 24 x 24 frames of 8-bit samples, each a lossless JPEG (SOF3, predictor 1). Its Huffman table gives
category s a code of 9 - s bits, so every sample takes exactly 9 bits with its extra bits, and whole clips are coded
and decoded with array operations. The container has an AVI header, one video stream (MJPG), a movi list and an idx1 index; the
reader finds frames by the index alone.

Shots: the grey histograms of neighbouring frames are compared, and a cut is where the difference exceeds the mean plus
`rise` deviations of the last `window` differences. Null and empty texts are one frame of padding. Equal texts give equal
bytes and features. Repeated rows and doc_ids come out each by itself, an empty table stays empty. One clip must stay below the 2 GB that a binary cell can hold.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

SIDE = 24
FRAME = SIDE * SIDE
FPS = 24
PAD = 255


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """9-bit word of each difference (offset by 255), and the difference of each word."""
    words, values = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = (1 << (9 - s)) - 2  # 9 - s bits: ones and a final zero
        words[d + 255] = (prefix << s) | (d if d > 0 else d + (1 << s) - 1 if d else 0)
        values[words[d + 255]] = d
    return words, values


_WORDS, _VALUES = _code_tables()
_SHIFTS = np.arange(8, -1, -1, dtype=np.uint16)
_SOF3 = b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, SIDE, SIDE, 1) + b"\x01\x11\x00"
_DHT = b"\xff\xc4" + struct.pack(">HB", 2 + 17 + 9, 0) + bytes([1] * 9 + [0] * 7) + bytes([8, 7, 6, 5, 4, 3, 2, 1, 0])
_SOS = b"\xff\xda" + struct.pack(">HB", 8, 1) + b"\x01\x00" + b"\x01\x00\x00"
_HEAD, _TAIL = b"\xff\xd8" + _SOF3 + _DHT + _SOS, b"\xff\xd9"


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """One lossless JPEG for each of (n, SIDE, SIDE) samples."""
    x = samples.astype(np.int16)
    diff = np.empty_like(x)
    diff[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    diff[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    diff[:, 0, 0] = x[:, 0, 0] - 128
    words = _WORDS[diff.reshape(len(x), FRAME) + 255]
    bits = ((words[:, :, None] >> _SHIFTS) & 1).astype(np.uint8).reshape(len(x), FRAME * 9)
    packed = np.packbits(bits, axis=1)
    return [_HEAD + row.tobytes().replace(b"\xff", b"\xff\x00") + _TAIL for row in packed]


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """(n, SIDE, SIDE) samples of frames that encode_frames() has made."""
    size = FRAME * 9 // 8
    scans = []
    for f in frames:
        if not (f.startswith(_HEAD) and f.endswith(_TAIL)):
            raise ValueError("not a frame of this codec")
        scan = f[len(_HEAD) : -len(_TAIL)].replace(b"\xff\x00", b"\xff")
        if len(scan) != size:
            raise ValueError("damaged frame")
        scans.append(scan)
    bits = np.unpackbits(np.frombuffer(b"".join(scans), np.uint8).reshape(len(frames), size), axis=1)
    words = bits.reshape(-1, 9) @ (1 << np.arange(8, -1, -1)).astype(np.uint16)
    diff = _VALUES[words].reshape(len(frames), SIDE, SIDE)
    first = 128 + np.cumsum(diff[:, :, 0], axis=1, dtype=np.int32)
    rows = diff.astype(np.int32)
    rows[:, :, 0] = first
    return np.cumsum(rows, axis=2, dtype=np.int32).astype(np.uint8)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return kind + struct.pack("<I", len(data)) + data + b"\x00" * (len(data) % 2)


def write_avi(frames: list[bytes]) -> bytes:
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, -1, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    parts, index, at = [b"movi"], [], 4
    for f in frames:
        chunk = _chunk(b"00dc", f)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        parts.append(chunk)
        at += len(chunk)
    body = b"AVI " + head + _chunk(b"LIST", b"".join(parts)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """The frames by the index, and the frames per second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index, fps = 12, None, None, float(FPS)
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif kind == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            found = data.find(b"avih", at, at + 8 + size)
            if found >= 0:
                fps = 1_000_000 / struct.unpack_from("<I", data, found + 8)[0]
        elif kind == b"idx1":
            index = np.frombuffer(data, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]), size // 16, at + 8)
        at += 8 + size + size % 2
    if movi is None or index is None:
        raise ValueError("no index")
    return [data[movi + a + 8 : movi + a + 8 + n] for a, n in zip(index["at"].tolist(), index["size"].tolist(), strict=True)], fps


def cuts(frames: np.ndarray, window: int = 8, rise: float = 3.0, least: float = 0.25) -> list[int]:
    """First frames of shots after the first: where the histogram difference exceeds what was usual just before."""
    n = len(frames)
    if n < 2:
        return []
    bins = (frames.reshape(n, -1) >> 3).astype(np.int64) + 32 * np.arange(n)[:, None]
    hist = np.bincount(bins.ravel(), minlength=32 * n).reshape(n, 32)
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2.0 * FRAME)
    total, square = np.concatenate([[0.0], np.cumsum(diff)]), np.concatenate([[0.0], np.cumsum(diff * diff)])
    at = np.arange(n - 1)
    low = np.maximum(0, at - window)
    count = np.maximum(1, at - low)
    mean = (total[at] - total[low]) / count
    deviation = np.sqrt(np.maximum(0.0, (square[at] - square[low]) / count - mean * mean))
    return (np.flatnonzero(diff > np.maximum(least, mean + rise * deviation)) + 1).tolist()


def payload(text: bytes) -> bytes:
    return text + bytes([PAD]) * (-len(text) % FRAME if text else FRAME)


def encode_media(docs: DataFrame) -> DataFrame:
    """`doc_id`, n_bytes and media (an AVI file) for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for at, end in _spans([len(t) for t in texts]):
                data = [payload(t) for t in texts[at:end]]
                frames = encode_frames(np.frombuffer(b"".join(data), np.uint8).reshape(-1, SIDE, SIDE))
                edges = np.concatenate([[0], np.cumsum([len(d) // FRAME for d in data])]).tolist()
                media = [write_avi(frames[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at:end], pa.int64()), pa.array([len(t) for t in texts[at:end]], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _spans(sizes: list[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Neighbouring rows of about a megabyte at a time, so that bit arrays stay small."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if sizes:
        yield start, len(sizes)


def clips(media: DataFrame) -> DataFrame:
    """One row per shot of each media row: doc_id, clip, first_frame, frames, start_s, end_s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                frames, fps = read_avi(data)
                edges = [0, *cuts(decode_frames(frames)), len(frames)]
                rows += [(doc, k, a, b - a, a / fps, b / fps) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["doc_id", "clip", "first_frame", "frames", "start_s", "end_s"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, clip int, first_frame long, frames long, start_s double, end_s double")


def media_digests(media: DataFrame) -> DataFrame:
    """What the stored bytes of each row hold, read back: digests of payload and media, the shots as a feature, and their times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            stored = batch.column(2).to_pylist()
            for at, end in _spans([len(x) for x in stored]):
                opened = [read_avi(x) for x in stored[at:end]]
                files = [frames for frames, _ in opened]
                samples = decode_frames([f for frames in files for f in frames])
                edges = np.concatenate([[0], np.cumsum([len(f) for f in files])]).tolist()
                for data, (_, rate), a, b in zip(stored[at:end], opened, edges[:-1], edges[1:], strict=True):
                    back, shots = samples[a:b].tobytes(), cuts(samples[a:b])
                    feature = f"frames={b - a};shots={len(shots) + 1};cuts={'|'.join(map(str, shots))}"
                    timed = [0, *shots, b - a]
                    timed = "|".join(f"{p / rate:.3f}-{q / rate:.3f}" for p, q in zip(timed, timed[1:]))
                    out.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, timed))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
