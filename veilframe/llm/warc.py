"""WARC archives through a chunked record table.

Writing: every page becomes a record whose payload is the page in UTF-8. Payloads above
``chunk_bytes`` leave as segments, the first as ``response`` and the rest as
``continuation`` records with their chunk number, so no record in an archive is longer
than a chunk and none is assembled in memory; the payload digest is carried from chunk
to chunk. Of records with equal payloads of at least ``min_revisit`` bytes the one with the
smallest id is a response and the others are revisits without payload. Archives are
gzip files written by Spark's own text writer, records ended by an empty line.

Reading: archives are unpacked as a stream and give rows of record id and chunk number.
A record in one piece is digested while it streams past; pieces of longer records meet
by record id, sorted by chunk number, and are digested one chunk at a time. Digests and
lengths are checked against the headers.

Defined results: a null page is empty; rows without an id are responses and come back
without one; rows that repeat an id and a payload have the same part (response where
the id is the payload's smallest) and come back as many rows; a null or odd url is kept
percent-encoded; no pages give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import query, table, utf8

CHUNK_BYTES = 1 << 20
FILE_BYTES = 32 << 20
DATE = "1970-01-01T00:00:00Z"  # the tables hold no fetch time

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PIECE = 1 << 16


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _header(fields: list[tuple[str, object]]) -> bytes:
    lines = ["WARC/1.1", *[f"{name}: {value}" for name, value in fields if value is not None]]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def _records(page, url, payload: bytes, first, copy: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page: one response, its continuations, or one revisit."""
    digest, size = hashlib.sha1(), len(payload)
    for at in range(0, size, chunk_bytes):
        digest.update(memoryview(payload)[at : at + chunk_bytes])
    name = "null" if page is None else quote(str(page), safe="")
    record = f"<urn:page:{name}:{copy}:{digest.hexdigest()}>"
    common = [
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else quote(url, safe="!#$&'()*+,/:;=?@[]~%")),
        ("WARC-Payload-Digest", "sha1:" + base32(digest.digest())),
        ("X-Page", None if page is None else name),
        ("X-Payload-Length", size),
    ]
    if first is not None:
        kind = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        refers = quote(str(first), safe="")
        yield _header(
            [("WARC-Type", "revisit"), ("WARC-Record-ID", record), *common, ("WARC-Profile", kind),
             ("WARC-Refers-To", f"<urn:page:{refers}:0:{digest.hexdigest()}>"), ("X-Refers-To-Page", refers),
             ("Content-Length", 0)]
        )
        return
    http = _HTTP % size
    chunks = max(1, -(-size // chunk_bytes))
    for k in range(chunks):
        piece = payload[k * chunk_bytes : (k + 1) * chunk_bytes]
        block = http + piece if k == 0 else piece
        segment = [("WARC-Segment-Number", k + 1)] if chunks > 1 else []
        if k == 0:
            kind = [("WARC-Type", "response"), ("WARC-Record-ID", record), ("Content-Type", "application/http;msgtype=response")]
        else:
            kind = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{record[:-1]}:{k + 1}>"), ("WARC-Segment-Origin-ID", record)]
            if k == chunks - 1:
                segment.append(("WARC-Segment-Total-Length", len(http) + size))
        yield _header([*kind, *segment, *common, ("Content-Length", len(block))]) + block


def write_archives(
    pages: DataFrame,
    path: str,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_revisit: int = 0,
    chunk_bytes: int = CHUNK_BYTES,
    file_bytes: int = FILE_BYTES,
) -> None:
    """Write all pages as gzip archives below ``path``."""
    rows = pages.select(F.col(key).alias("page"), F.col(url).cast("string").alias("url"), utf8(html).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    sizes = rows.select("page", "digest", F.octet_length("payload").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    firsts = sizes.where(F.col("n") >= min_revisit).groupBy("digest").agg(F.min("page").alias("first"), F.max("page").alias("last"))
    shared = firsts.where(F.col("first") < F.col("last")).select("digest", "first")
    later = sizes.join(shared, "digest").where(F.col("page") > F.col("first")).select("page", "digest", "first").distinct()
    files = max(1, -(-total // file_bytes))
    # the one shuffle of the payloads serves the join; ids spread evenly whatever their payloads share
    key_of = ["page", "digest"]
    placed = rows.repartition(files, *key_of).join(later.repartition(files, *key_of), key_of, "left")
    ordered = placed.sortWithinPartitions("page", "digest").select("page", "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, copy, opened = None, 0, False
        for batch in batches:
            for page, address, payload, first in zip(*(batch.column(k).to_pylist() for k in range(4))):
                digest = hashlib.sha1(payload).digest()
                copy = copy + 1 if last == (page, digest) else 0
                last = (page, digest)
                found = _records(page, address, payload, first, copy, chunk_bytes)
                if not opened:
                    opened = True
                    info = b"format: WARC File Format 1.1\r\n"
                    name = "<urn:info:%s>" % hashlib.sha1(digest + str(page).encode()).hexdigest()
                    head = _header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", name), ("WARC-Date", DATE),
                                    ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))])
                    yield pa.RecordBatch.from_pydict({"value": [head + info]}, schema=schema)
                for record in found:
                    yield pa.RecordBatch.from_pydict({"value": [record]}, schema=schema)

    schema = pa.schema([("value", pa.binary())])
    archived = ordered.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    archived.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


class _Stream:
    """Bytes of a gzip archive, unpacked piece by piece."""

    def __init__(self, packed: bytes):
        self.rest, self.unpack, self.held, self.at = memoryview(packed), zlib.decompressobj(31), b"", 0

    def _more(self) -> bool:
        while len(self.rest):
            if self.unpack.eof:  # archives may hold several gzip members
                self.unpack = zlib.decompressobj(31)
            piece = self.unpack.decompress(self.rest[:_PIECE])
            unused = len(self.unpack.unused_data)
            self.rest = self.rest[min(_PIECE, len(self.rest)) - unused :]
            if piece:
                self.held, self.at = self.held[self.at :] + piece, 0
                return True
        return False

    def line(self) -> bytes | None:
        while (end := self.held.find(b"\r\n", self.at)) < 0:
            if not self._more():
                return None
        line = self.held[self.at : end]
        self.at = end + 2
        return line

    def take(self, n: int) -> bytes:
        """Up to ``n`` of the next bytes."""
        if self.at >= len(self.held) and not self._more():
            raise ValueError("archive ends inside a record")
        piece = self.held[self.at : self.at + n]
        self.at += len(piece)
        return piece


def _parsed(packed: bytes, keep: bool) -> Iterator[dict]:
    """Chunk rows of one archive."""
    stream = _Stream(packed)
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {}
        while line := stream.line():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        kind, left = fields["warc-type"], int(fields["content-length"])
        if kind not in ("response", "continuation", "revisit"):
            while left:
                left -= len(stream.take(left))
            continue
        if kind == "response":
            while inner := stream.line():
                left -= len(inner) + 2
            left -= 2
        segment = fields.get("warc-segment-number")
        held, digest, size = [], hashlib.sha1(), left
        while left:
            piece = stream.take(min(left, _PIECE))
            left -= len(piece)
            if segment is None:
                digest.update(piece)
            if keep or segment is not None:
                held.append(piece)
        stated, length = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
        if kind == "response" and segment is None and (base32(digest.digest()), size) != (stated, length):
            raise ValueError(f"damaged payload in {fields['warc-record-id']}")
        page, refers = fields.get("x-page"), fields.get("x-refers-to-page")
        yield {
            "record_id": fields.get("warc-segment-origin-id", fields["warc-record-id"]),
            "page": None if page is None else unquote(page),
            "url": fields.get("warc-target-uri"),
            "record_type": "revisit" if kind == "revisit" else "response",
            "refers_to": None if refers is None else unquote(refers),
            "chunk": int(segment) - 1 if segment else 0,
            "split": segment is not None,
            "payload_bytes": length,
            "payload_digest": stated,
            "data": b"".join(held) if keep or segment is not None else None,
        }


_CHUNK = (
    "record_id string, page string, url string, record_type string, refers_to string, chunk int, split boolean, "
    "payload_bytes bigint, payload_digest string, data binary"
)
_CHUNK_ARROW = pa.schema(
    [("record_id", pa.string()), ("page", pa.string()), ("url", pa.string()), ("record_type", pa.string()),
     ("refers_to", pa.string()), ("chunk", pa.int32()), ("split", pa.bool_()), ("payload_bytes", pa.int64()),
     ("payload_digest", pa.string()), ("data", pa.binary())]
)


def read_chunks(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The chunked record table of the archives below ``path``; without ``payloads`` only split records keep data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for row in _parsed(content.as_py(), payloads):
                    rows.append(row)
                    held += len(row["data"] or b"")
                    if len(rows) >= 1000 or held >= CHUNK_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=_CHUNK_ARROW)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_CHUNK_ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, _CHUNK)


def _joined_digests(split: DataFrame) -> DataFrame:
    """One row per split record, after its chunks were digested in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(row, digest, size):
            if (base32(digest.digest()), size) != (row["payload_digest"], row["payload_bytes"]):
                raise ValueError(f"damaged or missing chunk in {row['record_id']}")
            return pa.RecordBatch.from_pylist([{n: row[n] for n in names}], schema=schema)

        row = digest = None
        size = 0
        for batch in batches:
            for k in range(batch.num_rows):
                one = {name: batch.column(name)[k].as_py() for name in (*names, "data")}
                if row is None or one["record_id"] != row["record_id"]:
                    if row is not None:
                        yield close(row, digest, size)
                    row, digest, size = one, hashlib.sha1(), 0
                digest.update(one["data"])
                size += len(one["data"])
        if row is not None:
            yield close(row, digest, size)

    names = ["record_id", "page", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    schema = pa.schema([_CHUNK_ARROW.field(n) for n in names])
    ordered = split.repartition("record_id").sortWithinPartitions("record_id", "chunk").select(*names, "data")
    kinds = "record_id string, page string, record_type string, refers_to string, payload_bytes bigint, payload_digest string"
    return ordered.mapInArrow(run, kinds)


def read_records(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """One row per record: page id, length and digest of the payload, record type, and the page a revisit refers to."""
    kept = scratch_path(spark, "warc-chunks")
    read_chunks(spark, path, payloads=False).write.parquet(kept)
    chunks = spark.read.parquet(kept)
    whole = chunks.where(~F.col("split")).select("record_id", "page", "record_type", "refers_to", "payload_bytes", "payload_digest")
    records = whole.unionByName(_joined_digests(chunks.where("split")))
    return records.select(
        F.col("page").cast(id_type).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(id_type).alias("refers_to"),
    )


@query("op9_warc_round_trip")
def op9_warc_round_trip(spark, sf_dir):
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_records(spark, path)
