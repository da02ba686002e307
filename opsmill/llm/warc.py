"""WARC records of web pages in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about ``FRAME_BYTES``; a bundle is
a file of frames that ends with a seek table in a skippable frame (sizes of every frame
before and after decompression, then a footer). The index maps each record to its bundle,
its frame and its place in the frame, so that one record is read with the table and one
frame. Tasks write bundles of bounded size to a temporary name and rename them; a task that
is run again writes the same bytes to the same name.

Payloads that are equal are found by digest: the smallest identifier is found by an
aggregation, and only the rows that repeat it are joined back, so that payloads move once.

Defined cases: a null payload is empty, a null address leaves its field out; line breaks in
an address are percent-encoded; payloads shorter than ``LEAST_BYTES`` and records without an
identifier are always responses; rows that repeat both identifier and payload of a response
are responses too; an empty table gives no bundles; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmill.llm.common import as_bytes, batch_of, fresh_path, small_batches, table, written

LEAST_BYTES = 100
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the seekable format and of WARC 1.1.
_SKIPPABLE = 0x184D2A5E
_SEEKABLE = 0x8F92EAB1
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, bundle string, frame int, offset int, length int"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit holds the head of the response alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
    ]
    if url is not None:
        clean = "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)
        fields.append(("WARC-Target-URI", clean))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", _IDENTICAL)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, bytes, int]:
    """Fields, HTTP head and payload of the record at a place, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    fields = dict(line.split(": ", 1) for line in lines)
    begin = end + 4
    stop = begin + int(fields["Content-Length"])
    head, _, payload = data[begin:stop].partition(b"\r\n\r\n")
    return fields, head, payload, stop + 4


class BundleWriter:
    """Frames of one bundle, held until the bundle is full."""

    def __init__(self) -> None:
        self.packer = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.open_bytes = self.packed_bytes = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and place in it of a record."""
        if self.open and self.open_bytes + len(data) > FRAME_BYTES:
            self.close_frame()
        place = len(self.frames), self.open_bytes
        self.open.append(data)
        self.open_bytes += len(data)
        return place

    def close_frame(self) -> None:
        if self.open:
            packed = self.packer.compress(b"".join(self.open))
            self.frames.append(packed)
            self.sizes.append((len(packed), self.open_bytes))
            self.packed_bytes += len(packed)
            self.open, self.open_bytes = [], 0

    def content(self) -> bytes:
        self.close_frame()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        return b"".join([*self.frames, struct.pack("<II", _SKIPPABLE, len(entries) + 9), entries, footer])


def seek_table(stream) -> list[tuple[int, int, int]]:
    """(offset, packed size, size) of the frames of an open bundle."""
    size = stream.size()
    count, _, magic = struct.unpack("<IBI", stream.read_at(9, size - 9))
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    entries = stream.read_at(8 * count, size - 9 - 8 * count)
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", entries):
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(stream, frame: tuple[int, int, int]) -> bytes:
    at, packed, plain = frame
    return zstandard.ZstdDecompressor().decompress(stream.read_at(packed, at), max_output_size=plain)


def _bundles(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        schema = pa.schema(
            [("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]
        )
        number, writer, rows = 0, BundleWriter(), []

        def finish() -> pa.RecordBatch:
            name = f"pages-{context.partitionId():06d}-{number:05d}.warc.zst"
            begun = f"{root}/.{name}.{context.taskAttemptId()}"
            with store.open_output_stream(begun) as out:
                out.write(writer.content())
            store.move(begun, f"{root}/{name}")
            columns = [list(c) for c in zip(*rows, strict=True)]
            return batch_of(schema, [columns[0], [name] * len(rows), *columns[1:]])

        for batch in batches:
            columns = batch.to_pydict()
            payloads = as_bytes(batch.column("html"))
            for page_id, url, digest, refers_to, payload in zip(
                columns["page_id"], columns["url"], columns["digest"], columns["refers_to"], payloads, strict=True
            ):
                data = record(page_id, url, payload, digest, refers_to)
                frame, offset = writer.add(data)
                rows.append((page_id, frame, offset, len(data)))
                if writer.packed_bytes >= BUNDLE_BYTES:
                    yield finish()
                    number, writer, rows = number + 1, BundleWriter(), []
        if rows:
            yield finish()

    return run


def write_bundles(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the bundles of all pages to a folder and returns the index of their records."""
    small_batches(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html",
        F.sha2(html.cast("binary"), 256).alias("digest"),
    )
    long = rows.filter((F.octet_length(html) >= LEAST_BYTES) & F.col("page_id").isNotNull())
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    firsts = firsts.filter("first < last").select("digest", F.col("first").alias("refers_to"))
    repeats = long.select("page_id", "digest").join(firsts, "digest").filter("page_id > refers_to").distinct()
    return written(
        rows.join(repeats, ["page_id", "digest"], "left")
        .sortWithinPartitions("page_id", "digest", "url")
        .mapInArrow(_bundles(folder), INDEX),
        "warc-index",
    )


def _number(urn: str | None) -> int | None:
    value = urn[len("<urn:page:") : -1] if urn else ""
    return int(value) if value else None


def _row(fields: dict[str, str], head: bytes, payload: bytes) -> tuple:
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(head.rsplit(b"Content-Length: ", 1)[1])
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: payload and digest differ")
    refers_to = _number(fields.get("WARC-Refers-To"))
    return _number(fields["WARC-Record-ID"]), size, digest, kind, refers_to


_ROW = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)
_ROW_SQL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the bundles of an index, read frame by frame and checked against its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                with store.open_input_file(f"{root}/{name}") as stream:
                    for frame in seek_table(stream):
                        data, at, rows = read_frame(stream, frame), 0, []
                        while at < len(data):
                            *found, at = parse(data, at)
                            rows.append(_row(*found))
                        yield batch_of(_ROW, [list(c) for c in zip(*rows, strict=True)])

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.select("bundle").distinct().repartition(parts, "bundle").mapInArrow(run, _ROW_SQL)


def fetch(index: DataFrame, folder: str) -> DataFrame:
    """page_id and payload of the records of an index, each read through its frame alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            payloads = []
            for row in batch.to_pylist():
                with store.open_input_file(f"{root}/{row['bundle']}") as stream:
                    data = read_frame(stream, seek_table(stream)[row["frame"]])
                payloads.append(parse(data[row["offset"] : row["offset"] + row["length"]])[2])
            yield batch_of(schema, [batch.column("page_id"), payloads])

    return index.mapInArrow(run, "page_id long, payload binary")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` as WARC records, written and read back."""
    folder = fresh_path(spark, "warc")
    return read_bundles(write_bundles(table(spark, sf_dir, "pages"), folder), folder)


OP7_SQL = """
WITH sized AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), first AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM sized
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM first
"""
