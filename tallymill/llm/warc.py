"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends in a footer: a seek table in a skippable frame,
with the compressed and uncompressed size of every frame. The index maps a record's identifier to its bundle, its frame
and its offset inside the decompressed frame, so one record is read by decompressing one frame.

Payload deduplication is a join on the payload's SHA-256; of equal payloads one is a response record, the others are
revisits that carry headers alone.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_dir, slices, small_side

#: Fixed values of the seekable format: skippable frame and footer magic numbers.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 20, 256 << 20, 3
REVISIT_FROM = 100
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(rid: str, kind: str, url: str, payload: bytes, digest: str, refers: str | None) -> bytes:
    """One WARC/1.1 record holding an HTTP response; a revisit has the response's headers without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at an offset of a decompressed frame."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) for x in lines[1:])
    start = stop + 4
    end = start + int(head["Content-Length"])
    return head, data[start:end], end + 4


def payload_of(block: bytes) -> tuple[int, bytes]:
    """The payload's declared length, and the bytes that the block has of it."""
    head, _, body = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length"))
    return length, body


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Footer for frames of (compressed, uncompressed) sizes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed size, uncompressed size) of each frame, from the end of a bundle."""
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    file.seek(size - 9 - n * width)
    raw, out, at = file.read(n * width), [], 0
    for i in range(n):
        c, u = struct.unpack_from("<II", raw, i * width)
        out.append((at, c, u))
        at += c
    return out


def _open(path: str):
    if path.startswith("/") or path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


class _Bundle:
    """A bundle being written: record() gives each record's frame and offset once its frame is closed."""

    def __init__(self, folder: str):
        self.name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        store, path = _open(self.name)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.frames, self.parts, self.size, self.total = store.open_output_stream(path, compression=None), [], [], 0, 0
        self.zip = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, data: bytes) -> tuple[int, int]:
        if self.size and self.size + len(data) > FRAME_BYTES:
            self.flush()
        at = (len(self.frames), self.size)
        self.parts.append(data)
        self.size += len(data)
        return at

    def flush(self) -> None:
        if self.parts:
            raw = b"".join(self.parts)
            packed = self.zip.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw)))
            self.total += len(packed)
            self.parts, self.size = [], 0

    def close(self) -> None:
        self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()


def record_id(page_id: str | None) -> str:
    """A record's URN: the page's identifier as text, percent-encoded; a null one has a name of its own."""
    return "urn:page" if page_id is None else f"urn:page:{quote(page_id, safe='')}"


def page_of(urn: str) -> str | None:
    """The identifier as text that record_id() was given."""
    text = urn.strip("<>").removeprefix("urn:page")
    return unquote(text[1:]) if text else None


INDEX = "page_id {id}, bundle string, frame int, frame_offset bigint, frame_bytes bigint, record_offset bigint"


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) to bundles in folder; returns the index, materialised.

    A null html is an empty payload and a null url an empty one. Of equal payloads of at least REVISIT_FROM bytes, the
    least page_id's is the response; null ids come last, and rows that share the least id are all responses. Bundles
    have names of their own for each attempt of a task, and the index names those of attempts that succeeded alone.
    page_id may be of any type that has an order and a text. Other columns are ignored; no rows make no bundle; a payload
    of any length is one record.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    raw = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), raw.alias("raw")).withColumn("digest", F.sha2("raw", 256))
    keys = materialize(rows.where(F.octet_length("raw") >= REVISIT_FROM).select("page_id", "digest"))
    equal = keys.groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    equal = materialize(equal.where("n > 1 and first is not null").select("digest", "first"))
    again = keys.join(small_side(equal, "digest"), "digest").where("page_id is null or page_id > first")
    again = materialize(again.select(F.col("page_id").alias("of"), F.col("digest").alias("sum"), "first").distinct())
    rows = rows.join(small_side(again, "sum"), F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("sum")), "left")
    rows = rows.select("page_id", F.col("page_id").cast("string").alias("name"), "url", "raw", "digest", F.col("first").cast("string").alias("first"))

    def run(batches):
        bundle, mine = None, []

        def closed():
            bundle.close()
            starts = [0]
            for c, _ in bundle.frames:
                starts.append(starts[-1] + c)
            cols = [pa.array([x[0] for x in mine], pages_type), pa.array([bundle.name] * len(mine)), pa.array([x[1] for x in mine], pa.int32())]
            cols += [pa.array([starts[x[1]] for x in mine], pa.int64()), pa.array([bundle.frames[x[1]][0] for x in mine], pa.int64()), pa.array([x[2] for x in mine], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=["page_id", "bundle", "frame", "frame_offset", "frame_bytes", "record_offset"])

        for b in slices(batches, 3):
            pages_type = b.schema.field(0).type
            for pid, name, url, data, digest, first in zip(*(c.to_pylist() for c in b.columns)):
                bundle = bundle or _Bundle(folder)
                refers = None if first is None else record_id(first)
                mine.append((pid, *bundle.add(record(record_id(name), "response" if first is None else "revisit", url, data, digest, refers))))
                if bundle.total >= BUNDLE_BYTES:
                    yield closed()
                    bundle, mine = None, []
        if bundle:
            yield closed()

    return materialize(rows.mapInArrow(run, INDEX.format(id=kind)))


def read(spark: SparkSession, index: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of the records in an index's bundles.

    Bundles are found from the index, frames from each bundle's seek table; a task reads one frame at a time. A
    response's digest is computed from what was read and must equal the declared one. payload is null for a revisit.
    """

    def frames(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                store, path = _open(name)
                with store.open_input_file(path) as file:
                    found = read_seek_table(file, file.size())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["bundle", "at", "size"])

    def records(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            for name, at, size in zip(*(c.to_pylist() for c in b.columns)):
                store, path = _open(name)
                with store.open_input_file(path) as file:
                    file.seek(at)
                    data = unzip.decompress(file.read(size))
                rows, i = [], 0
                while i < len(data):
                    head, block, i = parse(data, i)
                    length, body = payload_of(block)
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    full = head["WARC-Type"] == "response"
                    if full and (len(body) != length or hashlib.sha256(body).hexdigest() != digest):
                        raise ValueError(f"damaged record {head['WARC-Record-ID']} in {name}")
                    rows.append((page_of(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"], None if full else page_of(head["WARC-Refers-To"]), length, digest, body if full else None))
                types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    bundles = index.select("bundle").distinct()
    places = bundles.mapInArrow(frames, "bundle string, at bigint, size bigint").repartition("bundle", "at")
    found = places.mapInArrow(records, "page_id string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, payload binary")
    kind = index.schema["page_id"].dataType
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def lookup(index: DataFrame, ids: DataFrame) -> DataFrame:
    """(page_id, record BINARY) of the ids' records, each from its one frame; ids (page_id) without a record give no row."""
    kind = index.schema["page_id"].dataType.simpleString()

    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for name, at, size, start in zip(*(b.column(k).to_pylist() for k in ("bundle", "frame_offset", "frame_bytes", "record_offset"))):
                store, path = _open(name)
                with store.open_input_file(path) as file:
                    file.seek(at)
                    data = unzip.decompress(file.read(size))
                out.append(data[start : parse(data, start)[2]])
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(out, pa.binary())], names=["page_id", "record"])

    return index.join(ids.select("page_id").distinct(), "page_id").mapInArrow(run, f"page_id {kind}, record binary")


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages to bundles (by default in a new folder of the shared scratch space) and read the archives back."""
    spark = pages.sparkSession
    return read(spark, write(pages, folder or f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"))
