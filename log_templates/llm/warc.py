"""WARC archives: one gzip member per record, written by Spark and read back in sequence.

Writing: tasks turn rows into records, each its own gzip member, and Spark's text writer
and commit protocol put them into files of about `VOLUME_BYTES`, on any file system that
Spark knows.  The writer ends each line with a separator; a gzip member ends with its
length, whose last byte is 0 for less than 16 MB, so a member is handed over without its
last byte and the separator, byte 0, completes it.  Longer records are followed by an
empty member for the same reason.

Of records with equal payloads the one with the smallest id carries it; the others are
revisit records, without payload, that name it.

Reading: a file is fed to zlib in chunks; a member ends where zlib says so, a record is
framed by its header and Content-Length, and payload and block digests are verified.

Defined results.  A null payload or url counts as empty.  Rows with a null id revisit the
smallest id of their payload; if there is none, all of them are responses, as are all rows
that repeat that smallest id.  Line ends in a url are percent-encoded.  An empty table
gives an empty result.  A record that is cut off, has a wrong length or a wrong digest
raises an error when read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from log_templates.llm.common import Scratch, slices

VOLUME_BYTES = 16 * 2**20
CHUNK = 64 * 1024
MIN_REVISIT_BYTES = 0
LEVEL = 6
SALTS = 16
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes, level: int = LEVEL) -> bytes:
    """One gzip member with fixed header bytes, so equal records give equal bytes."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(page_id: int | None, serial: int, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """Bytes of a response or revisit record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}:{serial}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)),
        ("WARC-Block-Digest", "sha1:" + base32_sha1(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


@dataclass(frozen=True)
class Record:
    """One record as read: its header fields (lower-case names), HTTP header and payload."""

    fields: dict[str, str]
    http: dict[str, str]
    payload: bytes


def inflate(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The content of each gzip member of a stream, decompressed chunk by chunk."""
    engine, out = zlib.decompressobj(31), []
    started = False
    for chunk in chunks:
        while chunk:
            started = True
            piece = engine.decompress(chunk, CHUNK)
            if piece:
                out.append(piece)
            chunk = engine.unconsumed_tail
            if engine.eof:
                yield b"".join(out)
                chunk, engine, out, started = engine.unused_data, zlib.decompressobj(31), [], False
            elif not piece and not chunk:
                break
    # what zlib still holds of a member whose input has ended
    while started and not engine.eof and (piece := engine.decompress(engine.unconsumed_tail, CHUNK)):
        out.append(piece)
    if started:
        if not engine.eof:
            raise ValueError("the archive ends inside a gzip member")
        yield b"".join(out)


def _head(data: bytes, what: str) -> tuple[str, dict[str, str], int]:
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError(f"{what} without an end of its header")
    first, *lines = data[:end].decode("utf-8", "surrogateescape").split("\r\n")
    fields = {}
    for line in lines:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return first, fields, end + 4


def read_records(chunks: Iterable[bytes]) -> Iterator[Record]:
    """Records of one archive in order, each checked against its length and digests."""
    for data in inflate(chunks):
        if not data:
            continue
        first, fields, at = _head(data, "a record")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        length = int(fields["content-length"])
        block = data[at : at + length]
        if len(block) != length or data[at + length :] != b"\r\n\r\n":
            raise ValueError("a record's length is not its Content-Length")
        if fields.get("warc-block-digest", "") not in ("", "sha1:" + base32_sha1(block)):
            raise ValueError("a block differs from its digest")
        _, http, start = _head(block, "an HTTP block")
        payload = block[start:]
        if fields["warc-type"] == "response" and fields["warc-payload-digest"] != "sha1:" + base32_sha1(payload):
            raise ValueError("a payload differs from its digest")
        yield Record(fields, http, payload)


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members without their last byte, numbered into volumes."""
    volume, filled, serial = 0, 0, 0
    for part in slices(batches, 64):
        members, volumes = [], []
        for page_id, url, html, refers_to, revisit in zip(
            *(part.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "revisit")), strict=True
        ):
            made = record(page_id, serial, url or "", (html or "").encode("utf-8", "replace"), refers_to, revisit)
            serial += 1
            packed = member(made)
            if packed[-1]:
                packed += member(b"")
            if filled and filled + len(packed) > VOLUME_BYTES:
                volume, filled = volume + 1, 0
            filled += len(packed)
            members.append(packed[:-1])
            volumes.append(volume)
        yield pa.RecordBatch.from_arrays(
            [pa.array(members, pa.binary()), pa.array(volumes, pa.int32())], names=["member", "volume"]
        )


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Add which record carries each payload: `refers_to`, `revisit`."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = rows.withColumn("key", F.concat_ws(":", F.sha1(html), F.octet_length(html))).withColumn(
        "salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS))
    )
    # only payloads that occur more than once need a lookup; their few rows are repeated per salt
    groups = (
        rows.select("page_id", F.concat_ws(":", F.sha1(html), F.octet_length(html)).alias("key"), F.octet_length(html).alias("size"))
        .groupBy("key")
        .agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"), F.max("size").alias("size"))
        .where((F.col("n") > 1) & (F.col("size") >= min_bytes) & F.col("first_id").isNotNull())
        .select("key", "first_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    )
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return keyed.join(groups, ["key", "salt"], "left").select(
        "page_id", "url", "html", F.when(revisit, F.col("first_id")).alias("refers_to"), revisit.alias("revisit")
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write `page_id, url, html` as archives below ``path``, a folder that all executors share."""
    made = with_revisits(pages, min_bytes).mapInArrow(_records, "member binary, volume int")
    made.select(F.col("member").cast("string").alias("value"), "volume").write.partitionBy("volume").option(
        "lineSep", "\0"
    ).option("compression", "none").text(path)


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names
        )

    for batch in slices(batches, 1):
        content = memoryview(batch.column("content")[0].as_buffer())
        rows: list[tuple] = []
        for r in read_records(bytes(content[at : at + CHUNK]) for at in range(0, len(content), CHUNK)):
            own = r.fields["warc-record-id"].split(":")[2]
            other = r.fields.get("warc-refers-to", "").strip("<>").rpartition(":")[2]
            revisit = r.fields["warc-type"] == "revisit"
            rows.append(
                (
                    int(own) if own else None, r.fields["warc-target-uri"], None if revisit else r.payload,
                    int(r.http["content-length"]), r.fields["warc-payload-digest"].removeprefix("sha1:"),
                    r.fields["warc-type"], int(other) if other else None,
                )
            )
            if len(rows) >= 256:
                yield out(rows)
                rows = []
        yield out(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """`page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to` of all records."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(
        _read,
        "page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
        "record_type string, refers_to long",
    )


def round_trip(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    path = f"{scratch.path}/archives"
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
