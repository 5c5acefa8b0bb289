"""Web archives: one gzip member per record, written by Spark's text sink and read back record by record.

Of pages with one payload the one with the least page_id is stored as ``response``; the others are ``revisit`` records
that hold the HTTP header only and refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .text import reach, stored

DATE = "2024-01-01T00:00:00Z"
LEVEL, CHUNK = 3, 1 << 16
PER_FILE = 200_000
BREAK = b"\r\n"
#: An empty gzip member: it holds no record and ends in a zero byte.
EMPTY = zlib.compressobj(1, zlib.DEFLATED, 31)
EMPTY = EMPTY.compress(b"") + EMPTY.flush()


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    h = hashlib.sha256(f"page {page_id}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-4{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, uncompressed. Control characters and spaces in the address are escaped."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    head = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + BREAK
    return head + block + BREAK + BREAK


def member(data: bytes) -> bytes:
    """A gzip member whose last byte is 0: the high byte of the size, or that of an empty member behind it."""
    press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = press.compress(data) + press.flush()
    return out if out[-1] == 0 else out + EMPTY


def members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The content of each gzip member, decompressed bit by bit as the chunks come."""
    unpack, parts = zlib.decompressobj(31), []
    for chunk in chunks:
        while chunk:
            parts.append(unpack.decompress(chunk))
            chunk = unpack.unused_data
            if unpack.eof:
                if any(parts):
                    yield b"".join(parts)
                unpack, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends within a record")


def parsed(data: bytes) -> dict:
    """Fields of one record; raises if lengths or digests do not agree."""
    head, _, rest = data.partition(BREAK + BREAK)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(fields["content-length"])
    block, tail = rest[:size], rest[size:]
    if len(block) != size or tail != BREAK + BREAK:
        raise ValueError("the block has another length than its header says")
    if fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"block digest of {fields['warc-record-id']} differs")
    http, _, payload = block.partition(BREAK + BREAK)
    length = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1])
    is_revisit = fields["warc-type"] == "revisit"
    stated = fields["warc-payload-digest"].removeprefix("sha1:")
    if not is_revisit and (len(payload) != length or digest(payload) != stated):
        raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("x-page-id"), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
        "refers_to": number("x-refers-to-page-id"), "payload_bytes": length, "payload_digest": stated,
        "payload": None if is_revisit else payload,
    }


def write(pages: DataFrame, path: str) -> None:
    """Archives of all ``pages`` (page_id, url, html), one file per task, below ``path``.

    A null html is an empty payload. A null page_id comes after all others, so it is a response only where every page
    of its payload has none; of rows with one page_id and one payload all are responses if any is. The sink ends each
    value with one byte, and that byte is the last zero of the member, so the files hold nothing but members.
    """
    reach(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("same", F.unhex(F.sha2("html", 256)))
    # Stored, so that the join reads both sides from a shuffle and can split a frequent payload.
    groups = rows.groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("times"))
    first = stored(pages.sparkSession, groups.where("times > 1").select("same", "first"), "warc-first")
    joined = rows.join(first, "same", "left").select(
        "page_id", "url", F.col("html").cast("binary").alias("html"),
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"),  # null if there is none
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200).to_pydict()
                rows = zip(part["page_id"], part["url"], part["html"], part["refers_to"])
                yield pa.RecordBatch.from_arrays([pa.array([member(record(*r))[:-1] for r in rows], pa.binary())], ["value"])

    packed = joined.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.option("lineSep", "\0").option("maxRecordsPerFile", PER_FILE).text(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Every record of the archives below ``path``, checked: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest (of the full payload, for revisits too) and, if wanted, payload (null for revisits)."""
    columns = {
        "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(),
        "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary(),
    }
    if not payload:
        columns.pop("payload")
    sql = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}

    def packed(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in columns.items()], list(columns))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_buffer() if hasattr(content, "as_buffer") else content.as_py()
                chunks = (bytes(memoryview(data)[i : i + CHUNK]) for i in range(0, len(memoryview(data)), CHUNK))
                rows, size = [], 0
                for one in members(chunks):
                    rows.append(parsed(one))
                    size += len(one)
                    if size > 8 << 20:
                        yield packed(rows)
                        rows, size = [], 0
                if rows:
                    yield packed(rows)

    reach(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, ", ".join(f"{c} {sql[t]}" for c, t in columns.items()))


def round_trip(pages: DataFrame) -> DataFrame:
    """``pages`` written to the shared folder and read back."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path, payload=False)
