"""Operator 5: WARC archives, written and read record by record.

Every record is one gzip member, so an archive can be cut and joined at any record. The
reader inflates a stream a block at a time, frames the record by its content length,
hashes the payload as it passes and checks block and payload digests; it holds a block
and a header, not a record, unless payloads are asked for.

Pages with equal payloads of ``REVISIT_FROM`` bytes or more are stored once: the one with
the smallest page_id is the response, others are revisits that refer to it. Finding it
needs digests only; they are grouped in two steps by a salt, so that one payload on a
third of all pages is no hot key. Each task writes its own files; only the paths that
finished tasks report are read, so a repeated or lost task leaves no half archive behind.

Nulls: a null html is an empty payload, a null url leaves the target out, a null page_id
is written as such and never revisits. Rows that repeat a page_id are each written, with
their own payloads: as responses where theirs is the smallest page_id of its payload, else
as revisits. The writer holds one page and its compressed record at a time, so a very long
page takes memory of its own size. An empty table writes no file and gives no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, staged, table

REVISIT_FROM = 100
SALTS = 256
BLOCK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class BadArchive(ValueError):
    """An archive that breaks framing or whose digest does not match."""


def open_folder(uri: str):
    """(file system, path) of a folder in any store pyarrow knows, Hadoop's names for them
    included; ``dbfs:/`` is read where it is mounted."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("dbfs:"):
        return fs.LocalFileSystem(), "/dbfs/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    scheme, _, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")


def record_id(page_id, digest: str) -> str:
    """A page_id may stand for several payloads; with its digest it names one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member: WARC header, HTTP header, and the payload unless it revisits."""
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url))
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


class Member:
    """Bytes of one gzip member of a stream, inflated a block at a time."""

    def __init__(self, read, left: bytes):
        self.read, self.left, self.data = read, left, b""
        self.z = zlib.decompressobj(31)

    def more(self) -> bool:
        """Add inflated bytes to ``data``; False at the member's end."""
        while not self.z.eof:
            raw = self.z.unconsumed_tail or self.left or self.read(BLOCK)
            if not self.z.unconsumed_tail:
                self.left = b""
            if not raw:
                raise BadArchive("archive ends within a record")
            got = self.z.decompress(raw, BLOCK)
            if got:
                self.data += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        while (at := self.data.find(mark)) < 0:
            if not self.more():
                raise BadArchive("header without end")
        out, self.data = self.data[:at], self.data[at + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in blocks."""
        while n:
            if not self.data and not self.more():
                raise BadArchive("record shorter than its content length")
            part, self.data = self.data[:n], self.data[n:]
            n -= len(part)
            yield part


def fields(header: bytes) -> dict[str, str]:
    lines = header.decode().split("\r\n")
    return {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def read_records(read, with_payload: bool = False) -> Iterator[dict]:
    """Records of a stream; ``read(n)`` gives up to n raw bytes."""
    left = b""
    while left or (left := read(BLOCK)):
        member = Member(read, left)
        head = fields(member.until(b"\r\n\r\n"))
        if not head[""].startswith("WARC/"):
            raise BadArchive("not a WARC record")
        length, payload, kept = int(head["content-length"]), hashlib.sha256(), []
        block, http, size = hashlib.sha256(), b"", 0
        parts = member.take(length)
        for part in parts:
            block.update(part)
            if http is not None:
                http += part
                at = http.find(b"\r\n\r\n")
                if at < 0:
                    continue
                part, inner, http = http[at + 4 :], fields(http[:at]), None
            payload.update(part)
            size += len(part)
            if with_payload:
                kept.append(part)
        if http is not None:
            raise BadArchive("no HTTP header")
        if b"".join(member.take(4)) != b"\r\n\r\n" or member.data or member.more():
            raise BadArchive("record and gzip member do not end together")
        left = member.z.unused_data + member.left
        digest = head["warc-payload-digest"].removeprefix("sha256:")
        if block.hexdigest() != head["warc-block-digest"].removeprefix("sha256:"):
            raise BadArchive("block digest differs")
        kind = head["warc-type"]
        if kind == "response" and (payload.hexdigest() != digest or size != int(inner["content-length"])):
            raise BadArchive("payload digest differs")
        number = lambda k: int(head[k]) if k in head else None
        yield {"page_id": number("warc-page-id"), "url": head.get("warc-target-uri"), "payload_bytes": int(inner["content-length"]), "payload_digest": digest, "record_type": kind, "refers_to": number("warc-refers-to-page-id"), "payload": b"".join(kept) if with_payload else None}


def with_references(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and refers_to (null for responses)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    keys = rows.filter((F.octet_length("html") >= REVISIT_FROM) & F.col("page_id").isNotNull()).select("page_id", "digest", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("salt"))
    salted = keys.groupBy("digest", "salt").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    firsts = salted.groupBy("digest").agg(F.min("first").alias("refers_to"), F.max("last").alias("last")).filter("refers_to < last").select("digest", "refers_to")
    firsts = salted.select("digest", "salt").join(firsts, "digest")
    references = keys.join(firsts, ["digest", "salt"]).filter("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()
    return rows.join(references, ["page_id", "digest"], "left")


def write_archives(pages: DataFrame, folder: str, most: int = 256 << 20) -> DataFrame:
    """Write ``folder``/*.warc.gz, each up to about ``most`` bytes, and return the
    manifest of what finished tasks wrote: path and number of records."""

    def run(batches):
        fs, at = open_folder(folder)
        fs.create_dir(at, recursive=True)
        out, path, size, records = None, "", 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64())], ["path", "records"])

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = f"{at}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    out, size, records = fs.open_output_stream(path, compression=None), 0, 0
                data = record_bytes(page_id, url, html.encode(), digest, refers_to)
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= most:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    rows = with_references(pages).select("page_id", "url", "html", "digest", "refers_to")
    return staged(rows.mapInArrow(run, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Rows of RECORDS from the archives of a manifest, a file a task at a time."""

    def run(batches):
        fs, _ = open_folder(folder)
        names = [f.split()[0] for f in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_stream(path, compression=None) as stream:
                    rows = []
                    for record in read_records(stream.read):
                        rows.append([record[n] for n in names])
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(run, RECORDS)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    return read_archives(write_archives(table(spark, sf_dir, "pages"), folder), folder)


OP5_SQL = f"""WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {REVISIT_FROM} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to FROM f"""
