"""WARC archives of pages: a writer that records equal payloads once, and a sequential reader.

An archive is a run of gzip members, one per record. Archives are kept as rows (name, data) of a table in the shared
folder, which executors on any file system can write and read; `read_files` reads archives from files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.arrow import arrow_schema, rows_batch, slices

#: Compressed bytes after which an archive is closed, bytes that the reader takes at a time, compression level.
ARCHIVE_BYTES, CHUNK, LEVEL = 8 << 20, 1 << 16, 3
#: Fixed values of the format.
VERSION, END = b"WARC/1.0", b"\r\n\r\n"
#: Bytes that a record's header has at most.
HEADER = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(page_id) -> str:
    """The name of a page's record; a page without an id has none of its own."""
    return f"<urn:page:{'' if page_id is None else page_id}>"


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member."""
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), f"WARC-Block-Digest: sha1:{base32_sha1(block)}".encode(), f"Content-Length: {len(block)}".encode()]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(lines) + END + block + END) + packer.flush()


def info(name: str) -> bytes:
    return member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{name}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.0\r\n")


def page_record(page_id, url: str | None, size: int, digest: str, payload: bytes | None, refers_to) -> bytes:
    """A response with its payload, or a revisit that names the record which has it."""
    kind = "response" if payload is not None else "revisit"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if payload is None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers_to))]
    return member(headers, HTTP % size + (payload or b""))


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes


class WarcError(ValueError):
    """The bytes are no sound archive."""


def framed(raw: bytearray) -> int | None:
    """How long the record that begins like this is, with header and end, by its Content-Length; None as long as its header isn't whole."""
    cut = raw.find(END, 0, HEADER)
    if cut < 0:
        if len(raw) >= HEADER:
            raise WarcError("no record header")
        return None
    size = re.search(rb"(?i)\r\nContent-Length: *(\d+)(?:\r\n|$)", bytes(raw[:cut]))
    if size is None:
        raise WarcError("no length of the content")
    return cut + len(END) + int(size[1]) + len(END)


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of each gzip member, a record each; chunks may end anywhere.

    Members are inflated piece by piece, and as soon as one is longer than its record says, it is refused, however much it would inflate to.
    """
    unpack, raw, length = zlib.decompressobj(31), bytearray(), None
    started = False
    for chunk in chunks:
        while chunk:
            started = True
            raw += unpack.decompress(chunk, CHUNK)
            if length is None:
                length = framed(raw)
            if length is not None and len(raw) > length:
                raise WarcError("a record is longer than it says")
            chunk = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            if unpack.eof:
                yield bytes(raw)
                unpack, raw, length, started = zlib.decompressobj(31), bytearray(), None, False
    if started:
        raise WarcError("cut off in a record")


def records(chunks: Iterator[bytes]) -> Iterator[Record]:
    """Records in order. Lengths frame them; block digests, and payload digests of responses, are checked."""
    for raw in members(chunks):
        cut = raw.find(END)
        lines = raw[:cut].split(b"\r\n")
        if cut < 0 or lines[0] != VERSION:
            raise WarcError("no record header")
        headers = dict(line.decode("utf-8", "surrogateescape").split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        block = raw[cut + 4 : cut + 4 + size]
        if len(block) != size or raw[cut + 4 + size :] != END:
            raise WarcError(f"{headers.get('WARC-Record-ID')}: the content isn't as long as it says")
        if headers.get("WARC-Block-Digest", "").removeprefix("sha1:") != base32_sha1(block):
            raise WarcError(f"{headers.get('WARC-Record-ID')}: wrong block digest")
        record = Record(headers, block)
        if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != f"sha1:{base32_sha1(payload_of(record)[1])}":
            raise WarcError(f"{headers.get('WARC-Record-ID')}: wrong payload digest")
        yield record


def payload_of(record: Record) -> tuple[int, bytes]:
    """Length of the full payload as its header says, and the payload that the record itself has."""
    head, _, payload = record.block.partition(END)
    return int(re.search(rb"(?im)^Content-Length: *(\d+)", head)[1]), payload


def write_archives(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """name and data of archives with a record per row.

    Of rows with equal payloads of `min_bytes` or more, that with the largest id is a response and the others revisit it;
    rows that repeat that id are responses too. A null payload is an empty one. Rows with a null id revisit like others,
    or are responses where no row with an id has their payload. A payload that many rows share is dealt by its digest,
    where only the join with one row per digest meets it; Spark splits such partitions. An empty table has no archives.
    """
    payload = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "same": F.sha2("payload", 256)})  # the longer digest says what is equal
    last = rows.groupBy("same").agg(F.max("id").alias("last"))
    own = (F.octet_length("payload") < min_bytes) | F.col("last").isNull() | F.col("id").eqNullSafe(F.col("last"))
    joined = rows.join(last, "same").select(
        "id", "url", F.octet_length("payload").alias("size"), "sha1", F.when(own, F.col("payload")).alias("payload"), F.when(~own, F.col("last")).alias("last")
    )
    schema = arrow_schema("name string, data binary")

    def run(batches):
        part, number, data = TaskContext.get().partitionId(), 0, bytearray()

        def close():
            nonlocal number, data
            number += 1
            out = rows_batch([(f"pages-{part:06d}-{number:04d}.warc.gz", bytes(data))], schema)
            data = bytearray()
            return out

        for batch in slices(batches):
            for id_, url, size, sha1, body, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if not data:
                    data += info(f"pages-{part:06d}-{number + 1:04d}.warc.gz")
                data += page_record(id_, url, size, base64.b32encode(bytes.fromhex(sha1)).decode(), body, refers)
                if len(data) >= archive_bytes:
                    yield close()
        if data:
            yield close()

    return joined.mapInArrow(run, "name string, data binary")


def read_archives(archives: DataFrame, *, data_col: str = "data", payloads: bool = False) -> DataFrame:
    """One row per response or revisit: record_id, url, payload_bytes and payload_digest (both of the full payload),
    record_type, refers_to (the id that a revisit names) and, if asked for, payload. Null data has no records, an empty table no rows;
    the record of a page without an id has a null record_id."""
    ddl = "record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * payloads
    schema = arrow_schema(ddl)
    bare = lambda u: u.removeprefix("<urn:page:").removesuffix(">") or None

    def run(batches):
        for batch in batches:
            for value in batch.column(0):
                rows, held = [], 0
                view = value.as_buffer() if value.is_valid else b""
                size = len(view)
                for r in records(bytes(memoryview(view)[i : i + CHUNK]) for i in range(0, size, CHUNK)):
                    if r.headers["WARC-Type"] == "warcinfo":
                        continue
                    n, body = payload_of(r)
                    rows.append((bare(r.headers["WARC-Record-ID"]), r.headers.get("WARC-Target-URI"), n, r.headers["WARC-Payload-Digest"].removeprefix("sha1:"),
                                 r.headers["WARC-Type"], bare(r.headers["WARC-Refers-To"]) if "WARC-Refers-To" in r.headers else None, *([body] if payloads else [])))
                    held += len(body) * payloads
                    if len(rows) >= 5000 or held > CHUNK << 8:
                        yield rows_batch(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield rows_batch(rows, schema)

    return archives.select(data_col).mapInArrow(run, ddl)


def read_files(spark: SparkSession, path: str, *, payloads: bool = False) -> DataFrame:
    """`read_archives` of the .warc.gz files under a path of any file system that Spark reads."""
    return read_archives(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select(F.col("content").alias("data")), payloads=payloads)
