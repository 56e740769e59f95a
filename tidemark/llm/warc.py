"""WARC archives: write monolithic gzip files, normalise them to one member per record with a sidecar index, read back.

Each task writes its pages as WARC 1.1 records into gzip files that are one stream from end to end. The normaliser inflates
such a file once, in pieces, and rewrites every record as a member of its own, with an index of offsets beside it; readers
then fetch single records. Files go to the shared folder through pyarrow's file systems. A task attempt picks new file
names and reports them in its rows, so a repeated attempt leaves an orphan and never a mixed file.

Of pages with equal payloads of at least `least` bytes the one with the largest page_id is stored as a response, the others
as revisits of it; equal largest page_ids are all responses. A null html is an empty payload, a null url becomes an urn, and a null page_id
counts as the smallest. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, shared_path, text_bytes

URN = "urn:x-page:"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A task starts a new archive beyond so many uncompressed bytes.
ARCHIVE_BYTES = 256 << 20
_PIECE = 1 << 20


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record."""
    name = f"{URN}{'' if page_id is None else page_id}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    uri = quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else name
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    """Lower-case header names to values of a WARC or HTTP head."""
    rows = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (r.partition(":") for r in rows) if v}


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of an inflated stream; one record is held at a time."""
    held = bytearray()
    for piece in pieces:
        held += piece
        while (end := held.find(b"\r\n\r\n")) >= 0:
            fields = headers(bytes(held[:end]))
            size = end + 4 + int(fields["content-length"]) + 4
            if len(held) < size:
                break
            yield fields, bytes(held[:size])
            del held[:size]
    if held.strip():
        raise ValueError("the stream ends inside a record")


def inflate(file) -> Iterator[bytes]:
    """The bytes of a gzip stream (or of several members in a row), in pieces."""
    z = zlib.decompressobj(31)
    while data := file.read(_PIECE):
        while data:
            out = z.decompress(data, _PIECE)
            if out:
                yield out
            data = z.unconsumed_tail
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)
    if rest := z.flush():
        yield rest


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record_types(pages: DataFrame, least: int) -> DataFrame:
    """`pages` (page_id, url, payload) with revisit and refers_to."""
    digests = pages.select("page_id", F.sha1("payload").alias("digest"), F.length("payload").alias("bytes")).filter(F.col("bytes") >= least)
    per_page = digests.groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("rows"))
    shared = per_page.groupBy("digest").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("pages")).filter("pages > 1")
    revisits = per_page.join(shared, "digest").filter("page_id is null or page_id < largest").select(F.coalesce("page_id", F.lit(0)).alias("k_id"), F.col("page_id").isNull().alias("k_null"), F.col("digest").alias("k_digest"), "largest")
    keyed = pages.withColumns({"k_id": F.coalesce("page_id", F.lit(0)), "k_null": F.col("page_id").isNull(), "k_digest": F.sha1("payload")})
    return keyed.join(revisits, ["k_id", "k_null", "k_digest"], "left").select("page_id", "url", "payload", F.col("largest").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = 1000, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every page as a record of a monolithic gzip archive; (path, records, bytes) of each file."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out = z = path = None
        count = size = 0

        def close():
            out.write(z.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

        for batch in batches:
            for page, url, payload, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    path = f"{root}/raw-{uuid.uuid4().hex}.warc.gz"
                    out, z, count, size = store.open_output_stream(path, compression=None), zlib.compressobj(3, zlib.DEFLATED, 31), 0, 0
                data = record(page, url, payload, refers, refers is not None)
                out.write(z.compress(data))
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    spark = pages.sparkSession
    make_folder(spark, folder)
    return settle(record_types(rows, least).mapInArrow(run, "path string, records long, bytes long"), "archives")


def make_folder(spark, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive member by member; (path, offset, length, record_id, type), also written beside it as `.idx`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                path, at, index = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, []
                with store.open_input_stream(source, compression=None) as file, store.open_output_stream(path, compression=None) as out:
                    for fields, data in records(inflate(file)):
                        member = gzip_member(data)
                        out.write(member)
                        index.append((at, len(member), fields["warc-record-id"], fields["warc-type"]))
                        at += len(member)
                with store.open_output_stream(f"{path}.idx", compression=None) as out:
                    out.write("".join(f"{a}\t{n}\t{name}\t{kind}\n" for a, n, name, kind in index).encode())
                for k in range(0, len(index), 10_000):
                    a, n, name, kind = (list(c) for c in zip(*index[k : k + 10_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(a)), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(name), pa.array(kind)], ["path", "offset", "length", "record_id", "type"])

    spark = archives.sparkSession
    files = archives.count()
    spread = archives.select("path").repartition(max(1, files), "path")
    return settle(spread.mapInArrow(run, "path string, offset long, length long, record_id string, type string"), "index")


_LENGTH = re.compile(rb"(?i)^content-length:\s*(\d+)", re.M)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Fetch every indexed record by its offset: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def page(name: str) -> int | None:
        text = name.strip("<>").removeprefix(URN)
        return int(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        opened: dict[str, object] = {}
        for batch in batches:
            rows = []
            for path, at, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if path not in opened:
                    for f in opened.values():
                        f.close()
                    opened = {path: store.open_input_file(path)}
                data = zlib.decompress(opened[path].read_at(n, at), 31)
                head, _, block = data.partition(b"\r\n\r\n")
                fields = headers(head)
                http, _, payload = block[:-4].partition(b"\r\n\r\n") if fields["warc-type"] == "response" else (block[:-8], b"", b"")
                stated = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                if fields["warc-type"] == "response":
                    size, digest, refers = len(payload), hashlib.sha1(payload).hexdigest(), None
                    if digest != stated:
                        raise ValueError(f"damaged record {fields['warc-record-id']}")
                else:
                    size, digest, refers = int(_LENGTH.search(http)[1]), stated, page(fields["warc-refers-to"])
                rows.append((page(fields["warc-record-id"]), size, digest, fields["warc-type"], refers))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        for f in opened.values():
            f.close()

    files = index.select("path").distinct().count()
    rows = index.select("path", "offset", "length").repartition(max(1, files), "path").sortWithinPartitions("path", "offset")
    return rows.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least: int = 1000, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write `pages`, normalise the archives, and read every record back."""
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    raw = write_archives(pages, folder, least, archive_bytes)
    index = normalise(raw, folder)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(conf)
    for status in store.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/raw-*.warc.gz")) or []:
        store.delete(status.getPath(), False)
    return read_records(index, folder)
