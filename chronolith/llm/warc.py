"""WARC archives with revisit records for repeated payloads.

Headers alone are shuffled, by payload digest: of the records with equal payloads, the one with the
smallest id stays a response and the others become revisits of it. Verdicts are joined to the pages,
by broadcast once they are counted to be few, else by one shuffle into hash tables without a sort. Every
record is rendered with fresh headers and packed as a gzip member of its own into archives of about
ARCHIVE_BYTES, each of which starts with a warcinfo record. Spark's own writer writes them, so any store
that Spark knows can hold them; its line end after an archive is a zero byte, which gzip readers take
for padding.

Reading unpacks each archive member by member, checks every block and payload against its digest, tells
where in which archive a record lies, and joins each revisit to its original.

Defined results: a null payload counts as empty; a null url is an empty target; rows that share both
the smallest id and the payload are all responses, and rows equal in id, url and payload share a record
id; a row of null id can be a revisit but is an original only among null ids, where all are responses;
a page longer than an archive makes one by itself; an empty table writes and reads no record; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, by_small_key, scratch, table, written

# Fixed values of the format.
VERSION = "WARC/1.1"
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Compressed bytes from which an archive is full; an archive is packed and read in one piece.
ARCHIVE_BYTES = 8 << 20
#: Payload bytes of the rows that reading gives out at once.
BATCH_BYTES = 8 << 20


def payload_digest(payload: Column) -> Column:
    """SHA-1 in upper-case base32: 5 hexadecimal digits give 4 of base 32."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def python_digest(payload: bytes) -> str:
    return b32encode(hashlib.sha1(payload).digest()).decode()


def headers(pages: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes and payload_digest of each page, without its payload."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select("page_id", "url", F.octet_length(payload).cast("long").alias("payload_bytes"), payload_digest(payload).alias("payload_digest"))


def revisits(heads: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_digest, refers_to and refers_to_url of every record that becomes a revisit."""
    originals = heads.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.min_by("url", "page_id").alias("refers_to_url"), F.min("page_id").alias("refers_to"))
    originals = originals.filter("n > 1 and refers_to is not null").select(by_small_key(F.col("payload_digest")).alias("__digest"), "refers_to", "refers_to_url")
    found = heads.select("page_id", "payload_digest").join(originals, F.col("payload_digest") == F.col("__digest"))
    return found.filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "payload_digest", "refers_to", "refers_to_url").distinct()


def _urn(*parts: Column) -> Column:
    """A record id from what identifies the record."""
    h = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-"))][:-1], F.lit(">"))


def records(pages: DataFrame, verdicts: DataFrame, date: str) -> DataFrame:
    """For each page the header lines of its record but for lengths and digests of the block, and the block."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", "html", payload_digest(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(F.encode(html, "UTF-8")).alias("n"))
    small = verdicts.limit(BROADCAST_KEYS // 10 + 1).count() <= BROADCAST_KEYS // 10
    to = verdicts.select(F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest"), "refers_to", "refers_to_url")
    rows = rows.join(F.broadcast(to) if small else to.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    clean = lambda c: F.translate(F.coalesce(c, F.lit("")), "\r\n", "")
    is_revisit = F.col("__digest").isNotNull()
    http = F.concat(F.lit(CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "])), F.col("n").cast("string"), F.lit(CRLF * 2))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(is_revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _urn(page, F.col("digest"), clean(F.col("url")))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), clean(F.col("url"))),
        F.concat(F.lit("WARC-Page-ID: "), page),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        # concat is null where it is no revisit, and concat_ws leaves nulls out
        F.when(is_revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("refers_to").cast("string"), F.col("digest"), clean(F.col("refers_to_url"))))),
        F.when(is_revisit, F.concat(F.lit("WARC-Refers-To-Target-URI: "), clean(F.col("refers_to_url")))),
        F.when(is_revisit, F.lit(f"WARC-Refers-To-Date: {date}")),
        F.when(is_revisit, F.concat(F.lit("WARC-Refers-To-Page-ID: "), F.col("refers_to").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response"),
    ]
    return rows.select(F.concat_ws(CRLF, *lines).alias("head"), F.concat(http, F.when(is_revisit, "").otherwise(html)).alias("block"))


def _member(head: bytes, block: bytes) -> bytes:
    """A record with the rest of its headers, as a gzip member."""
    end = CRLF.encode()
    rest = f"WARC-Block-Digest: sha1:{python_digest(block)}{CRLF}Content-Length: {len(block)}".encode()
    packer = zlib.compressobj(wbits=31)
    return packer.compress(end.join((head, rest, b"", block, b"", b""))) + packer.flush()


def packed(rows: DataFrame, date: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Rows of records() as archives, one a row."""

    def start() -> bytes:
        head = CRLF.join((VERSION, "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields"))
        return _member(head.encode(), f"format: WARC File Format 1.1{CRLF}".encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for head, block in zip(batch.column("head"), batch.column("block"), strict=True):
                held = held or [start()]
                held.append(_member(head.as_buffer().to_pybytes(), block.as_buffer().to_pybytes()))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])

    return rows.mapInArrow(run, "value binary")


def write_archives(pages: DataFrame, path: str, date: str | None = None, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a record for each row of pages (page_id, url, html) to archives under path, dated now or as given."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    heads = written(headers(pages), "warc-heads")
    verdicts = written(revisits(heads, least_bytes), "warc-revisits")
    archives = packed(records(pages, verdicts, date), date, archive_bytes)
    # a cast of bytes to a string leaves them as they are
    archives.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def members(content: memoryview) -> Iterator[tuple[int, bytes]]:
    """Offset and unpacked bytes of every gzip member, zero bytes behind the last one left out."""
    at = 0
    while at < len(content) and content[at]:
        unpacker, start, out = zlib.decompressobj(wbits=31), at, []
        while not unpacker.eof:
            if at >= len(content):
                raise ValueError(f"the archive is cut short in the member at {start}")
            piece = content[at : at + (1 << 16)]
            out.append(unpacker.decompress(piece))
            at += len(piece) - len(unpacker.unused_data)
        yield start, b"".join(out)


def parse_archive(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of an unpacked archive or member, one at a time."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts at {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('warc-record-id')} is cut short")
        if fields.get("warc-block-digest", "").startswith("sha1:") and fields["warc-block-digest"][5:] != python_digest(block):
            raise ValueError(f"record {fields.get('warc-record-id')} does not match its block's digest")
        yield fields, block


READ_SCHEMA = "page_id long, url string, record_id string, record_type string, refers_to long, payload_digest string, payload_bytes long, archive string, offset long"


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each response and revisit as READ_SCHEMA says, with_payload also html (null in revisits).

    Digest and length are those of the payload read; a revisit carries the digest of its header and
    no length. offset is where in the archive the record's member starts.
    """
    schema = READ_SCHEMA + (", html string" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64() if x.endswith("long") else pa.string() for x in schema.split(", ")]

    def number(text: str | None) -> int | None:
        return int(text) if text else None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, size = [], 0
                for offset, member in members(memoryview(content.as_buffer())):
                    for f, block in parse_archive(io.BytesIO(member)):
                        if f["warc-type"] not in ("response", "revisit"):
                            continue
                        digest = f["warc-payload-digest"].removeprefix("sha1:")
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        response = f["warc-type"] == "response"
                        if response and python_digest(payload) != digest:
                            raise ValueError(f"record {f['warc-record-id']} does not match its digest")
                        row = (number(f["warc-page-id"]), f["warc-target-uri"], f["warc-record-id"], f["warc-type"], number(f.get("warc-refers-to-page-id")), digest, len(payload) if response else None, archive, offset)
                        rows.append(row + ((payload.decode() if response else None,) if with_payload else ()))
                        size += len(payload) if with_payload else 100
                        if size >= BATCH_BYTES:
                            yield batch_of(rows)
                            rows, size = [], 0
                yield batch_of(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, schema)


def resolved(found: DataFrame) -> DataFrame:
    """Records as read, each revisit with the length (and payload, if read) of its original."""
    rest = [c for c in ("payload_bytes", "html") if c in found.columns]
    originals = found.filter("record_type = 'response'").select(F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest"), *[F.col(c).alias(f"__{c}") for c in rest])
    originals = originals.dropDuplicates(["__id", "__digest"]).withColumn("__digest", by_small_key(F.col("__digest")))
    seen = found.filter("record_type = 'revisit'").join(originals, (F.col("refers_to") == F.col("__id")) & (F.col("payload_digest") == F.col("__digest")))
    seen = seen.select(*[F.col(f"__{c}").alias(c) if c in rest else F.col(c) for c in found.columns])
    return found.filter("record_type = 'response'").unionByName(seen)


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), path)
    rows = written(read_archives(spark, path), "warc-read")
    return resolved(rows).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
