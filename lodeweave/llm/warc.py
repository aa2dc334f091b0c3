"""WARC writing and reading through a chunked record table.

A record is one or more rows (archive, record number, chunk number, text): a payload
over ``chunk_bytes`` becomes a first segment and `continuation` segments, as WARC/1.0
defines them, cut from the payload's bytes one by one. Rows are dealt to archives as
they are made, and an archive is full only at a record's end, so none ends between
segments. Spark's text sink writes them, whose line separator is the two empty lines
that end a WARC record: each file is a WARC archive (gzip by default, one member a
file), committed by Spark's own protocol, in a folder that only Spark need reach.
Reading streams each archive block by block and carries one running digest per
record over its segments.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.common import join_counted, scratch_path, with_row_id

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
CHUNK_BYTES = 256 * 1024
ARCHIVE_RECORDS, ARCHIVE_BYTES = 20_000, 256 * 1024 * 1024
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"  # of every payload, not part of it
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hexadecimal digits make four characters."""
    digest = F.sha1(payload)
    marks = []
    for group in range(8):
        number = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        marks += [F.substring(F.lit(BASE32), F.shiftright(number, 15 - 5 * i).bitwiseAND(31) + 1, F.lit(1)) for i in range(4)]
    return F.concat(*marks)


def revisits(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(__rid, refers_to, refers_rid): rows whose payload an earlier key's row has, with the smallest such key and its row.

    rows: __rid, k, digest, size, and no payload. Only digests that occur again are
    joined back, and those of very many rows without moving these."""
    again = rows.where((F.col("size") >= min_bytes) & F.col("k").isNotNull()).groupBy("digest", "size")
    again = again.agg(F.min(F.struct("k", "__rid")).alias("first"), F.count("*").alias("n")).where("n > 1")
    found = join_counted(rows, again.select("digest", "size", F.col("first.k").alias("refers_to"), F.col("first.__rid").alias("refers_rid"), "n"), ["digest", "size"], "n")
    return found.where("refers_to < k").select("__rid", "refers_to", "refers_rid")


ROWS = "archive string, rid long, chunk int, record string"


def _name(key, rid: int, chunk: int) -> str:
    return f"<urn:x-page:{'' if key is None else key}:{rid}.{chunk}>"


def _cuts(data: memoryview, size: int) -> list[tuple[int, int]]:
    """Where to cut UTF-8 bytes into pieces of at most size bytes, whole characters each."""
    out, at = [], 0
    while len(data) - at > size:
        end = at + size
        while end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append((at, end))
        at = end
    return [*out, (at, len(data))]


def _segments(chunk_bytes: int, per_archive: int, archive_bytes: int):
    """Arrow function over (rid, key, url, digest, refers_to, refers_rid, payload): ROWS, a chunk at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, archive, records, filled = TaskContext.get().partitionId(), 0, 0, 0
        for b in batches:
            for rid, key, url, digest, to, to_rid, payload in zip(*(b.column(i).to_pylist() for i in range(6)), b.column(6), strict=True):
                data = memoryview(payload.as_buffer()) if payload.is_valid and to is None else memoryview(b"")
                if records and (records >= per_archive or filled + len(data) > archive_bytes):
                    archive, records, filled = archive + 1, 0, 0
                records, filled = records + 1, filled + len(data)
                cuts = _cuts(data, chunk_bytes)
                for n, (lo, hi) in enumerate(cuts):
                    kind = "continuation" if n else "response" if to is None else "revisit"
                    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(key, rid, n)}", f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z"]
                    block = b"" if n else HEAD
                    if not n:
                        lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
                    if to is not None:
                        lines += [f"WARC-Refers-To: {_name(to, to_rid, 0)}", f"WARC-Profile: {PROFILE}", f"X-Payload-Bytes: {len(payload.as_buffer()) if payload.is_valid else 0}"]
                    if len(cuts) > 1:
                        lines.append(f"WARC-Segment-Number: {n + 1}")
                    if n:
                        lines.append(f"WARC-Segment-Origin-ID: {_name(key, rid, 0)}")
                        if n == len(cuts) - 1:
                            lines.append(f"WARC-Segment-Total-Length: {len(HEAD) + len(data)}")
                    lines.append(f"Content-Length: {len(block) + hi - lo}")
                    yield f"{part}-{archive}", rid, n, "\r\n".join(lines).encode("utf-8", "surrogatepass") + END.encode() + block + bytes(data[lo:hi])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = rows(batches), 0
        while True:
            out, held = [], 0
            for row in made:
                out.append(row)
                held += len(row[3])
                if held >= 1 << 22:
                    break
            if not out:
                return
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns[:3], columns[3].cast(pa.string())], names=[x.split()[0] for x in ROWS.split(", ")])

    return run


def records(pages: DataFrame, key: str, url: str, payload: str, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, per_archive: int = ARCHIVE_RECORDS, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """The chunked record table (ROWS): the WARC text of every segment.

    Null payloads are empty, null urls '-'. Equal payloads of at least min_bytes
    bytes: the smallest key's record is the response, the others' are revisits
    (rows that repeat a key are responses of their own). A null key is written as
    an empty id, refers to no record and is never referred to."""
    base = pages.select(F.col(f"`{key}`").alias("k"), F.regexp_replace(F.coalesce(F.col(f"`{url}`"), F.lit("-")), r"[\r\n]", " ").alias("u"), F.coalesce(F.col(f"`{payload}`"), F.lit("")).alias("p"))
    base = with_row_id(base.withColumn("digest", base32_sha1(F.col("p"))).withColumn("size", F.octet_length("p").cast("long")))
    found = revisits(base.select("__rid", "k", "digest", "size"), min_bytes)
    rows = base.join(found, "__rid", "left").select("__rid", "k", "u", "digest", "refers_to", "refers_rid", F.col("p").cast("binary").alias("p"))
    return rows.mapInArrow(_segments(chunk_bytes, per_archive, archive_bytes), ROWS)


def write(record_table: DataFrame, path: str, compression: str = "gzip") -> None:
    """A folder per archive, named by its number. The table's own deal is kept: no shuffle."""
    ordered = record_table.sortWithinPartitions("archive", "rid", "chunk").select("archive", "record")
    ordered.write.partitionBy("archive").option("lineSep", END).option("compression", compression).text(path)


LENGTH = re.compile(rb"\r\nContent-Length: (\d+)")
READ_BLOCK = 1 << 20


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, chunk payload) of an archive, gzip or plain, inflated a block at a time."""
    zipped = content[:2] == b"\x1f\x8b"
    inflate = zlib.decompressobj(31)
    buffer, at = bytearray(), 0
    blocks = (content[i : i + READ_BLOCK] for i in range(0, len(content), READ_BLOCK))

    def more() -> bool:
        for block in blocks:
            buffer.extend(inflate.decompress(block) if zipped else block)
            return True
        return False

    while True:
        while (head := buffer.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if buffer[at:].strip():
                    raise ValueError("an archive ends within a record's headers")
                return
        lines = bytes(buffer[at:head])
        size = int(LENGTH.search(lines)[1])
        start = head + 4
        while len(buffer) < start + size + 4:
            if not more():
                raise ValueError("an archive ends within a record")
        names = dict(x.split(": ", 1) for x in lines.decode("utf-8").split("\r\n")[1:])
        yield names, bytes(buffer[start : start + size])
        at = start + size + 4
        if at > READ_BLOCK:
            del buffer[:at]
            at = 0


FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row per record (FIELDS): sizes and digests of responses are computed from the segments as they stream by.

    A response whose digest or total length differs from its headers raises an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out, state = [], None
                for head, chunk in parse(content.as_py()):
                    if head["WARC-Type"] != "continuation":
                        if state:
                            out.append(_finish(*state))
                        state = (head, hashlib.sha1(), [0, 0], {})
                        if head["WARC-Type"] == "response":
                            state[2][1] = chunk.index(b"\r\n\r\n") + 4  # the HTTP head
                            chunk = memoryview(chunk)[state[2][1] :]
                    state[1].update(chunk)
                    state[2][0] += len(chunk)
                    state[3].update(head)
                if state:
                    out.append(_finish(*state))
                if out:
                    columns = zip(*out, strict=True)
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    names = [x.split()[0] for x in FIELDS.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, FIELDS)


def _finish(head: dict[str, str], digest, size: list[int], last: dict[str, str]) -> tuple:
    number = head["WARC-Record-ID"].split(":")[2]
    number = int(number) if number else None
    declared = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "revisit":
        return number, head["WARC-Target-URI"], int(head["X-Payload-Bytes"]), declared, "revisit", int(head["WARC-Refers-To"].split(":")[2])
    if "WARC-Segment-Total-Length" in last and int(last["WARC-Segment-Total-Length"]) != sum(size):
        raise ValueError(f"page {number}: segments of {size[0]} bytes, not as many as declared")
    found = base64.b32encode(digest.digest()).decode()
    if found != declared:
        raise ValueError(f"page {number}: the payload's digest isn't the one declared")
    return number, head["WARC-Target-URI"], size[0], found, "response", None


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write pages as archives (to path, or a new place in the shared folder) and read them back."""
    path = path or scratch_path(pages.sparkSession, "warc")
    write(records(pages, key, url, payload, min_bytes), path)
    return read(pages.sparkSession, path)
