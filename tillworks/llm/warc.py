"""WARC archives with revisits resolved: one stored payload per digest.

1. Headers only (digest, page, length) are shuffled by payload digest and aggregated
   to the page that keeps the payload; copies combine before the shuffle.
2. Pages join those groups. Pages that refer to another page become revisit records
   without payload; the join is left to Spark, which splits a digest that
   a third of all pages share.
3. Every record gets fresh headers and is one gzip member; Spark's text writer
   stores them in the shared folder, with its commit protocol. The writer ends
   each row with a separator, so the last byte of a member, always zero (a
   member of 16 MB and more is followed by an empty one), is left to the separator.
   Each task begins a new file when ``FILE_BYTES`` or ``RECORDS_PER_FILE`` are reached.
4. Archives are read back file by file and parsed by Content-Length.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillworks.llm.common import STEP_BYTES, staged, steps, text_of
from tillworks.session import fresh_path

# The names and line forms of WARC 1.1 that the records carry.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 1000
FILE_BYTES = 32 << 20
GZIP_LEVEL = 3
CAPTURED = "1970-01-01T00:00:00Z"

RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest_groups(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """For digests of at least ``min_bytes`` that several pages have: the page that keeps the payload."""
    heads = pages.select(
        "page_id", F.sha1(text_of("html").cast("binary")).alias("digest"), F.octet_length(text_of("html")).alias("n")
    )
    groups = heads.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("copies"))
    return groups.where("copies > 1 AND target IS NOT NULL").select("digest", "target")


def resolved(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages with ``target``: the page a revisit refers to, null for responses; revisits carry no payload."""
    groups = staged(digest_groups(pages, min_bytes), "digest-targets")
    keyed = pages.select("page_id", "url", text_of("html").alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    keyed = keyed.withColumn("n_bytes", F.octet_length("html").cast("long"))
    joined = keyed.join(groups, "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("target")), F.col("target"))
    return joined.select(
        "page_id", "url", "digest", "n_bytes", refers.alias("target"), F.when(refers.isNull(), F.col("html").cast("binary")).alias("payload")
    )


def base32_digest(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_urn(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url or str()}' if page_id is None else f'page:{page_id}')}>"


def one_line(value: str | None) -> str:
    return " ".join((value or "").split())


def record_bytes(page_id, url, digest: str, n_bytes: int, target, payload: bytes | None) -> bytes:
    """One uncompressed WARC record."""
    body = payload or b""
    lines = [
        VERSION,
        f"WARC-Type: {'response' if target is None else 'revisit'}",
        f"WARC-Record-ID: {record_urn(page_id, url)}",
        f"WARC-Date: {CAPTURED}",
        f"WARC-Target-URI: {one_line(url)}",
        f"WARC-Payload-Digest: sha1:{base32_digest(digest)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
        f"X-Payload-Length: {n_bytes}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if target is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_urn(target, None)}", f"X-Refers-To-Page: {target}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = GZIP_LEVEL) -> bytes:
    """A gzip member that ends with a zero byte."""
    packed = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = packed.compress(data) + packed.flush()
    if out[-1]:
        empty = zlib.compressobj(level, zlib.DEFLATED, 31)
        out += empty.flush()
    return out


def _members(batches: Iterator[pa.RecordBatch], file_bytes: int) -> Iterator[pa.RecordBatch]:
    """Members and the number, in this task, of the file each goes to."""
    number, held = 0, 0
    for batch in steps(batches, "payload"):
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for at in range(0, batch.num_rows, 256):
            part = [c.slice(at, 256).to_pylist() for c in columns]
            members = [gzip_member(record_bytes(*row))[:-1] for row in zip(*part)]
            numbers = []
            for member in members:
                if held and held + len(member) + 1 > file_bytes:
                    number, held = number + 1, 0
                held += len(member) + 1
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary()), pa.array(numbers, pa.int64())], ["member", "file"])


def write_archives(records: DataFrame, path: str, per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Write resolved records as gzip members, at most ``per_file`` or ``file_bytes`` to a file; a larger record has its own."""
    narrow = records.select("page_id", "url", "digest", "n_bytes", "target", "payload")
    members = narrow.mapInArrow(partial(_members, file_bytes=file_bytes), "member binary, file long")
    rows = members.select(F.col("member").cast("string").alias("value"), "file")
    rows.write.partitionBy("file").option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(path)


def parse_records(stream: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of every record, one gzip member after the other."""
    at = 0
    while at < len(stream):
        unpack = zlib.decompressobj(31)
        data = unpack.decompress(memoryview(stream)[at:]) + unpack.flush()
        at = len(stream) - len(unpack.unused_data)
        if not data:
            continue
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(headers["Content-Length"])
        if rest[size:] != b"\r\n\r\n":
            raise ValueError("a record's length differs from its Content-Length")
        yield headers, rest[:size]


def _parsed(headers: dict[str, str], payload: bytes) -> tuple:
    kind = headers["WARC-Type"]
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(headers["X-Payload-Length"])
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("a payload differs from its digest")
    page, target = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page")
    return (
        None if page is None else int(page),
        headers["WARC-Target-URI"],
        size,
        digest,
        kind,
        None if target is None else int(target),
        payload if kind == "response" else None,
    )


def _records(keep_payload: bool):
    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("payload", pa.binary()),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for headers, payload in parse_records(content.as_py()):
                    row = _parsed(headers, payload)
                    rows.append(row if keep_payload else (*row[:-1], None))
                    held += len(payload) if keep_payload else 0
                    if len(rows) == 256 or held > STEP_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return read


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """The records of all archive files under ``path``; payloads are checked against their digests."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_records(keep_payload), RECORD)


def deduplicated_archives(pages: DataFrame, min_bytes: int = 0) -> str:
    """Write the archives of ``pages`` (page_id, url, html) to a new shared folder and return its path.

    Payload: html in UTF-8, null as empty. Of pages with equal payloads of at least
    ``min_bytes`` the one with the largest page_id is the response, the others
    revisit it; smaller payloads are all responses. Repeated rows of the largest
    page_id are all responses. A page without id revisits like any other and is never
    the one referred to, unless no copy has an id: then all are responses. An empty
    table writes an empty archive; columns besides the three are not read.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(resolved(pages, min_bytes), path)
    return path


def headers_of(records: DataFrame) -> DataFrame:
    kinds: list[str | Column] = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return records.select(*kinds)
