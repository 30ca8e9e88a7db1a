"""WARC archives and the chunked record table.

Pages are written as gzip-per-record WARC 1.1 archives: a payload seen before (by SHA-256, of min_bytes at least) becomes
a revisit record that names the first. Archives are read back as a stream of rows (archive, record_no, chunk_no) with a
bounded chunk of the payload and the digest of the payload so far, so no record is ever held whole.

Records have ids of their own: one that revisits name has it from its payload, all others from their place. Where several rows
are the first of a payload (a repeated page_id), its revisits name the page only, as the format allows.

Defined cases: null html is an empty payload; rows that repeat a page_id with the same payload are all of the type of
that page_id; a null page_id counts as larger than any; an empty table gives no archive and no rows; any url is
percent-encoded where a header could not hold it; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import files
from textloom.llm.common import blocks, chosen, members, new_path, written

CHUNK = 256 << 10
ARCHIVE_BYTES = 64 << 20
_NAMES = uuid.UUID("6f1a2b50-9d0e-5c1c-8a57-0e6c3f5f7a11")
ROW = "archive string, record_no long, chunk_no int, record_id string, page_id long, record_type string, refers_to long, declared_bytes long, chunk binary, chunk_bytes int, digest_so_far string"
_ROW = pa.schema([("archive", pa.string()), ("record_no", pa.int64()), ("chunk_no", pa.int32()), ("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("declared_bytes", pa.int64()), ("chunk", pa.binary()), ("chunk_bytes", pa.int32()), ("digest_so_far", pa.string())])


def with_types(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to and named: whether the response that a payload's revisits mean has an id from the payload.

    Payloads that occur twice are found by digests alone, and only they go through a join, whose hot partitions adaptive
    execution splits; a bitmap of bounded size lets all others by.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= min_bytes
    ids = rows.where(large).groupBy("digest", "page_id").count()
    firsts = ids.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.min_by("count", "page_id").alias("firsts"), F.sum("count").alias("n")).where("n > 1 AND first_id IS NOT NULL").drop("n")
    firsts = written(firsts, "warc-repeats")
    about = pages.sparkSession.sparkContext.broadcast(members(firsts.select(F.xxhash64("digest").alias("hash"))))
    key = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("small "), F.xxhash64("page_id", "url").cast("string")))
    first = F.col("page_id").eqNullSafe(F.col("first_id"))
    again = F.col("first_id").isNotNull() & ~first
    repeated = chosen(rows.withColumn("key", key), key, about).join(firsts.withColumnRenamed("digest", "key"), "key", "left").select(
        "page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"), F.coalesce(F.col("firsts") == 1, F.lit(False)).alias("named")
    )
    single = chosen(rows, key, about, inside=False).select("*", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("named"))
    return repeated.unionAll(single)


def record_id(of: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, of)}>"


def _head(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None) + b"\r\n"


class ArchiveWriter:
    """Each record is a gzip member of its own, written in pieces of at most CHUNK."""

    def __init__(self, out, name: str):
        self.out, self.name, self.bytes, self.records = out, name, 0, 0
        self._member(_head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(f"info {name}")), ("Content-Type", "application/warc-fields"), ("Content-Length", 0)]), [])

    def _member(self, head: bytes, body) -> None:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        for piece in (head, *body, b"\r\n\r\n"):
            self._put(z.compress(piece))
        self._put(z.flush())

    def _put(self, raw: bytes) -> None:
        if raw:
            self.out.write(raw)
            self.bytes += len(raw)

    def add(self, page_id, url, payload: memoryview, digest, kind, refers_to, named: bool) -> None:
        self.records += 1
        payload_id = record_id(f"payload {digest}")
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        body = payload if kind == "response" else memoryview(b"")
        fields = [
            ("WARC-Type", kind),
            ("WARC-Record-ID", payload_id if named and kind == "response" else record_id(f"record {self.name} {self.records}")),
            ("WARC-Target-URI", quote(url, safe="".join(map(chr, range(0x21, 0x7F)))) if url is not None else None),
            ("WARC-Payload-Digest", f"sha256:{digest}"),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None),
            ("WARC-Refers-To", payload_id if named and kind == "revisit" else None),
            ("X-Page-Id", page_id),
            ("X-Refers-To-Page-Id", refers_to),
            ("Content-Type", "application/http;msgtype=response"),
            ("Content-Length", len(http) + len(body)),
        ]
        self._member(_head(fields) + http, (body[i : i + CHUNK] for i in range(0, len(body), CHUNK)))

    def close(self) -> None:
        self.out.close()


def write_archives(typed: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """A manifest row for each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, made = None, []
        for batch in blocks(batches, "payload"):
            payload, rest = batch.column("payload"), batch.drop_columns(["payload"]).to_pylist()
            for i, row in enumerate(rest):
                if archive is None:
                    out, name = files.create(folder, ".warc.gz")
                    archive = ArchiveWriter(out, name)
                archive.add(row["page_id"], row["url"], memoryview(payload[i].as_buffer()), row["digest"], row["record_type"], row["refers_to"], row["named"])
                if archive.bytes >= archive_bytes:
                    archive.close()
                    made.append(name)
                    archive = None
        if archive is not None:
            archive.close()
            made.append(name)
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["archive"])

    return written(typed.mapInArrow(run, "archive string"), "warc-manifest")


def _header(f) -> dict[str, str] | None:
    line = f.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    out = {}
    while (line := f.readline().rstrip(b"\r\n")):
        k, _, v = line.decode().partition(": ")
        out[k.lower()] = v
    return out


def records(archive: str, f) -> Iterator[tuple]:
    """Rows of the chunked record table, in order; the payload's digest is checked at its end."""
    no = 0
    while (h := _header(f)) is not None:
        left = int(h["content-length"])
        if h["warc-type"] in ("response", "revisit"):
            declared = None
            while True:  # the HTTP header
                line = f.readline()
                left -= len(line)
                if line in (b"\r\n", b""):
                    break
                if line.lower().startswith(b"content-length:"):
                    declared = int(line.split(b":")[1])
            whole = h.get("warc-payload-digest", "").removeprefix("sha256:")
            same = (h["warc-record-id"], int(h["x-page-id"]) if "x-page-id" in h else None, h["warc-type"], int(h["x-refers-to-page-id"]) if "x-refers-to-page-id" in h else None, declared)
            digest, chunk_no = hashlib.sha256(), 0
            while left or not chunk_no:
                chunk = f.read(min(CHUNK, left))
                if left and not chunk:
                    raise ValueError(f"{archive}: a record is cut short")
                left -= len(chunk)
                digest.update(chunk)
                so_far = digest.hexdigest() if h["warc-type"] == "response" else whole
                if not left and so_far != whole:
                    raise ValueError(f"{archive}: a payload has another digest than its record says")
                yield (archive, no, chunk_no, *same, chunk, len(chunk), so_far)
                chunk_no += 1
            no += 1
        while left:
            left -= len(f.read(min(CHUNK, left)))
        f.read(4)


def read_chunks(manifest: DataFrame, folder: str, data: bool = True) -> DataFrame:
    """The chunked record table. data=False leaves `chunk` null where only sizes and digests are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows, held = [], 0
                with files.stream(folder, name) as raw, gzip.GzipFile(fileobj=raw) as f:
                    for row in records(name, f):
                        held += 500 + row[9] * data
                        rows.append(row if data else (*row[:8], None, *row[9:]))
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(n, "archive").mapInArrow(run, ROW)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROW.types, strict=True)], schema=_ROW)


def payloads(chunks: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to. Chunks of a record come from one task, so the sums are made before the shuffle."""
    return (
        chunks.groupBy("archive", "record_no")
        .agg(
            F.first("page_id").alias("page_id"),
            F.when(F.first("record_type") == "revisit", F.first("declared_bytes")).otherwise(F.sum("chunk_bytes")).cast("long").alias("payload_bytes"),
            F.max_by("digest_so_far", "chunk_no").alias("payload_digest"),
            F.first("record_type").alias("record_type"),
            F.first("refers_to").alias("refers_to"),
        )
        .drop("archive", "record_no")
    )


def round_trip(pages: DataFrame, min_bytes: int = 100, archive_bytes: int = ARCHIVE_BYTES, data: bool = True) -> DataFrame:
    folder = new_path(pages.sparkSession, "warc")
    return payloads(read_chunks(write_archives(with_types(pages, min_bytes), folder, archive_bytes), folder, data))
