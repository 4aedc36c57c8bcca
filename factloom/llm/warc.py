"""WARC: archives of one gzip member per record, and a reader that goes through them once.

Writing makes a ``response`` record of a page, or a ``revisit`` record where the payload
equals that of an earlier page (by the profile "identical payload digest": its HTTP head
alone). Reading inflates a member bit by bit, frames the record by its content length, and
verifies block and payload digests.

Defined results: null html is an empty payload; payloads under ``revisit_bytes`` are always
responses; of equal ones the smallest non-null ``page_id`` responds, and all rows with that
id; where all ids are null, all respond; an empty table gives an empty result; other
columns than id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attempt, frugal, open_file, put_file, scratch, shuffle_partitions, stored, table

CRLF = b"\r\n"
#: Fixed values of the format (WARC 1.1).
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: No date is in the input; a fixed one keeps a second attempt's bytes the same.
DATE = "1970-01-01T00:00:00Z"
CHUNK = 1 << 16
#: Rows with equal payloads under which they are no hot group, however small the table.
LEAST_HOT = 100


class WarcError(ValueError):
    pass


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]

    def http(self) -> tuple[dict[str, str], bytes]:
        head, found, body = self.block.partition(CRLF * 2)
        if not found:
            raise WarcError("no HTTP head")
        return _fields(head.split(CRLF)[1:]), body


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.partition(b":") for line in lines if line)
    return {k.decode().strip().lower(): v.decode().strip() for k, _, v in pairs}


def _digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def _id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}|{digest}'.encode()).digest())}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A gzip member with the page's record."""
    digest = _digest(payload)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _id(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": " ".join((url or "").split()),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": digest,
        "WARC-Block-Digest": _digest(block),
    }
    if page_id is not None:
        fields["X-Page-ID"] = str(page_id)
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _id(refers_to, digest), "X-Refers-To-Page-ID": str(refers_to)}
    fields["Content-Length"] = str(len(block))
    lines = CRLF.join(f"{k}: {v}".encode() for k, v in fields.items())
    pack = zlib.compressobj(5, zlib.DEFLATED, 31)
    return pack.compress(CRLF.join([VERSION, lines, b"", block + CRLF * 2])) + pack.flush()


def _members(src) -> Iterator[Iterator[bytes]]:
    """For each gzip member the pieces of its content, inflated as they are read."""
    rest = src.read(CHUNK)
    while rest:
        unpack = zlib.decompressobj(31)

        def pieces(unpack=unpack):
            nonlocal rest
            while not unpack.eof:
                if not rest:
                    raise WarcError("cut gzip member")
                yield unpack.decompress(rest, CHUNK)
                rest = unpack.unconsumed_tail or unpack.unused_data or (b"" if unpack.eof else src.read(CHUNK))

        yield pieces()
        if not rest:
            rest = src.read(CHUNK)


def read_records(src) -> Iterator[Record]:
    """Records of an archive in file order; raises ``WarcError`` on what isn't whole."""
    for pieces in _members(src):
        data = bytearray()
        end = -1
        for piece in pieces:
            data += piece
            if end < 0 and (end := data.find(CRLF * 2)) >= 0:
                break
        if end < 0 or not data.startswith(VERSION):
            raise WarcError("no record head")
        headers = _fields(bytes(data[:end]).split(CRLF)[1:])
        size = int(headers["content-length"])
        for piece in pieces:
            data += piece
        block = bytes(data[end + 4 : end + 4 + size])
        if len(block) < size or data[end + 4 + size :] != CRLF * 2:
            raise WarcError("block of another length than told")
        if headers["warc-block-digest"] != _digest(block):
            raise WarcError("bad block digest")
        record = Record(headers, block)
        if record.kind == "response" and headers["warc-payload-digest"] != _digest(record.http()[1]):
            raise WarcError("bad payload digest")
        yield record


def _write(folder: str, file_bytes: int):
    schema = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, size, out = attempt(), 0, 0, []

        def flush():
            nonlocal number, size, out
            path = f"{folder}/pages-{own}-{number:05d}.warc.gz"
            put_file(path, b"".join(out))
            row = pa.RecordBatch.from_pylist([{"path": path, "records": len(out)}], schema)
            number, size, out = number + 1, 0, []
            return row

        for batch in batches:
            for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.append(record_bytes(page, url, (html or "").encode(), refers))
                size += len(out[-1])
                if size >= file_bytes:
                    yield flush()
        if out:
            yield flush()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows = []
            with open_file(path) as src:
                for r in read_records(src):
                    page, refers = r.headers.get("x-page-id"), r.headers.get("x-refers-to-page-id")
                    rows.append((page and int(page), int(r.http()[0]["content-length"]), r.headers["warc-payload-digest"].partition(":")[2], r.kind, refers and int(refers), r.headers["warc-target-uri"]))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 100, file_bytes: int = 32_000_000) -> DataFrame:
    """Writes the archives and returns their list (path, records).

    Digests of two rows or more are grouped to their smallest id. Pages with one of those that
    hold more rows than an even partition has, of which there are no more than partitions, meet
    them by a broadcast; small payloads meet nothing; only the rest is shuffled by digest. Rows
    may come to a task in any order: an attempt's files have names of their own, and the list
    has those of finished attempts alone.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= revisit_bytes, F.sha2(F.col("html").cast("binary"), 256)))
    parts = shuffle_partitions(pages.sparkSession)
    equal = rows.where("digest is not null").groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1")
    equal = stored(equal, "warc-equal")
    even = max(LEAST_HOT, (equal.agg(F.sum("n")).first()[0] or 0) // parts)
    hot = equal.where(F.col("n") > even).select("digest", "first", F.lit(True).alias("hot"))  # no more than partitions
    marked = rows.join(F.broadcast(hot), "digest", "left")
    alone = F.col("digest").isNull() | F.col("hot").isNotNull()
    calm = marked.where(~alone).drop("first", "hot").join(equal.where(F.col("n") <= even).select("digest", "first"), "digest", "left")
    refers = F.when(~F.coalesce(F.col("page") == F.col("first"), F.col("first").isNull()), F.col("first"))
    joined = marked.where(alone).drop("hot").unionByName(calm).select("page", "url", "html", refers.alias("refers"))
    return stored(joined.mapInArrow(frugal(_write(folder, file_bytes)), "path string, records long"), "warc-files")


def read_archives(files: DataFrame) -> DataFrame:
    """A row for each record of the listed archives."""
    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    return files.select("path").repartition(max(1, 2 * shuffle_partitions(files.sparkSession)), "path").mapInArrow(frugal(_read), ddl)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read_archives(files).drop("url")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
