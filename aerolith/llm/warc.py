"""WARC archives: a writer, and a splittable reader that looks for gzip members in byte ranges (operator 1).

Writing: each record is a gzip member of its own. Spark's text writer puts the members in files, byte for byte, so
that any file system it knows will do and a lost task leaves nothing behind; between members it puts an empty one (20
bytes), which is a valid member that holds no record.

Reading: files are cut into ranges. A task scans its range for the gzip magic; a candidate counts as a member if its
header decodes and what follows inflates to the start of a record (or to nothing). Records that start in the range are
the task's, and it reads on past the range's end for the last of them. Ranges need no index, and a magic number
inside compressed data fails the test. A record whose member is damaged is skipped up to the next member.

Of pages with equal payloads of at least `least` bytes the one with the smallest id is a response and the others revisit
it, smaller ones are all responses. A null payload is empty. Rows that repeat the smallest id are all responses; a null id
comes after all others and is written as such. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm.common import LAST_ID, bounded_batches, cut, hold, order_id, original_id, remove, shared_dir

RANGE, AHEAD = 8 << 20, 256 << 10
MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 0xFF, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
RECORD = "page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plan(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload (binary), refers_to (null: a response)."""
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(order_id("page_id").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha1("payload")))
    # one row for each payload that occurs in several pages; the map side has summed up each task's. A table of its own, so
    # that the join is one of two plain shuffles, and Spark can split a payload that many pages have
    first = rows.where(F.length("payload") >= least).groupBy("key").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").drop("last")
    joined = rows.join(cut(first, "first-pages"), "key", "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed. A revisit has no body, but its payload's length and digest."""
    body = payload if refers_to is None else b""
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        *([("WARC-Target-URI", re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url))] if url is not None else []),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Payload-Length", str(len(payload))),
        *([] if refers_to is None else [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(body))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + body + b"\r\n\r\n"


def write(planned: DataFrame, path: str) -> None:
    """Archives of the rows of plan() in a new folder."""

    def members(batches):
        for batch in batches:
            refers = batch.column("refers_to").to_pylist()
            rows = zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("payload").to_pylist(), refers, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(record(*row), 5, mtime=0) for row in rows], pa.binary())], ["member"])

    # the cast keeps the bytes as they are, and so does the writer
    rows = planned.mapInArrow(members, "member binary").select(F.col("member").cast("string"))
    rows.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none").text(path)


def opened(uri: str):
    """A file that can be read from any place, by its full URI: a shared folder, or a store that Arrow knows."""
    if re.match(r"file:|/", uri):
        return open(re.sub(r"^file:(//)?", "", uri), "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))
    return store.open_input_file(path)


def ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """path, start, end of all byte ranges of a folder's files (the files' contents are not read)."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long")))
    return files.select("path", "length", starts.alias("start")).select("path", "start", F.least(F.col("start") + size, "length").alias("end"))


def inflate(file, start: int, buffer: bytes) -> tuple[bytes, int] | None:
    """A member that begins at `start` (of which `buffer` holds the first bytes): its content, and where it ends. None: it is no member."""
    stream, out, at = zlib.decompressobj(31), [], start + len(buffer)
    try:
        piece = stream.decompress(buffer)
        out.append(piece)
        while not stream.eof:
            file.seek(at)
            buffer = file.read(AHEAD)
            if not buffer:
                return None
            at += len(buffer)
            out.append(stream.decompress(buffer))
    except zlib.error:
        return None
    return b"".join(out), at - len(stream.unused_data)


def begins_record(head: bytes) -> bool:
    """Whether bytes that begin with the magic are a gzip header, followed by what inflates to a record or to nothing."""
    if len(head) >= 4 and head[3] & 0xE0:
        return False
    stream = zlib.decompressobj(31)
    try:
        text = stream.decompress(head, 16)
    except zlib.error:
        return False
    return text.startswith(b"WARC/") or (not text and stream.eof)


def scan(file, start: int, end: int):
    """The contents of the records whose members start in [start, end)."""
    at = start
    while at < end:
        file.seek(at)
        window = file.read(min(end - at, RANGE) + AHEAD)
        base, i = at, 0
        while (i := window.find(MAGIC, i)) >= 0 and base + i < end:
            if len(window) - i < AHEAD and base + len(window) < end:
                break  # too near the window's end to judge
            if not begins_record(window[i : i + 4096]) or (found := inflate(file, base + i, window[i : i + AHEAD])) is None:
                i += 1
                continue
            if found[0].startswith(b"WARC/"):
                yield found[0]
            i = found[1] - base
            if i >= len(window):
                break
        at = base + i if i >= 0 and base + i > at else base + max(len(window) - len(MAGIC) + 1, 1)
        if not window:
            return


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    return fields, rest[: int(fields.get("Content-Length", 0))]


def read(spark: SparkSession, path: str, size: int = RANGE, payloads: bool = True) -> DataFrame:
    """The records of a folder's archives; a response's length and digest are taken from its payload."""

    def number(uri: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
        return int(found[1]) if found else None

    def records(batches):
        names = [x.split()[0] for x in RECORD.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        rows, held = [], 0
        for batch in batches:
            for uri, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
                with opened(uri) as file:
                    for content in scan(file, start, end):
                        fields, body = parse(content)
                        kind = fields.get("WARC-Type")
                        own = kind != "revisit"
                        length = len(body) if own else int(fields.get("WARC-Payload-Length", 0))
                        sha = digest(body) if own else fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                        rows.append((number(fields.get("WARC-Record-ID")), kind, fields.get("WARC-Target-URI"), length, sha, number(fields.get("WARC-Refers-To")), body if payloads and own else None))
                        held += len(body)
                        if held > RANGE or len(rows) >= 2000:
                            yield batch_of(rows)
                            rows, held = [], 0
        if rows:
            yield batch_of(rows)

    found = ranges(spark, path, size)
    tasks = spark.sparkContext.defaultParallelism * 4
    return found.repartition(tasks, "path", "start").mapInArrow(records, RECORD)


def query(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    planned = plan(pages)
    try:
        write(planned, path)
    finally:
        hold(spark, path)
    rows = cut(read(spark, path, payloads=False).drop("payload", "url"), "records")
    remove(spark, path)
    return rows.select(original_id("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("refers_to") != LAST_ID, F.col("refers_to")).alias("refers_to"))


ORACLE = """
with p as (
  select page_id, encode(coalesce(html, '')) as body, sha1(coalesce(html, '')) as hex from pages
), f as (
  select p.*, min(page_id) over (partition by hex) as first from p
)
select page_id, octet_length(body) as payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         cast(((cast('0x' || substr(hex, cast(5 * (i // 4) + 1 as bigint), 5) as bigint) >> cast(15 - 5 * (i % 4) as integer)) & 31) + 1 as bigint), 1)), 'string_agg', '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id = first then null else first end as refers_to
from f
"""
