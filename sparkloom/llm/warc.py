"""WARC writing, and a salvage reader.

Writing: one record per page, response or (for a payload written already under a smaller id) revisit,
by Spark's own text writer with the record separator as line separator. Its commit protocol keeps
the archives whole when an executor is lost, and any file system that Spark writes to will do.

Reading: archives come in by the binaryFile source, plain or gzipped (a member for each record, or
for many), one file per row; that source takes files of up to 2 GB. Records leave the task in batches of ``BATCH`` bytes. Each record is checked (version line, lengths, separators, block and payload
digest, the gzip checksum). After a failed check the reader searches for the next version line or gzip member, goes
on from the first that passes, and logs the bytes in between as a gap. Of a gzip member that breaks off or fails its
checksum the records that came out before and pass their own checks are kept.

Defined results: a null page is an empty payload; a null id is never the smallest of its group, and alone
in a group all such rows are responses, as are equal rows of the smallest id; control characters in a url
are dropped; further columns are not written; an empty table gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

LEAST_REVISITED = 100
RECORDS_PER_FILE = 1000
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"
BATCH = 16 << 20
VERSION = re.compile(rb"WARC/[01]\.\d+\r\n")
START = re.compile(rb"WARC/[01]\.|\x1f\x8b\x08")


def with_kinds(pages: DataFrame, key: str, page: str) -> DataFrame:
    """``pages`` with ``_payload``, ``_bytes``, ``_digest`` and ``_refers`` (the id of the response, for revisits)."""
    made = pages.withColumn("_payload", F.coalesce(page, F.lit(""))).withColumn("_bytes", F.octet_length("_payload").cast("long")).withColumn("_digest", F.sha2("_payload", 256))
    # Combined before the exchange; only digests that occur twice are joined back.
    first = (
        made.where(F.col("_bytes") >= LEAST_REVISITED).groupBy("_digest")
        .agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_digest").alias("_d"), "_first")
    )
    again = F.col("_first").isNotNull() & (F.col(key).isNull() | (F.col(key) > F.col("_first")))
    return made.join(first, F.col("_digest") == F.col("_d"), "left").withColumn("_refers", F.when(again, F.col("_first"))).drop("_d", "_first")


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def _urn(key: Column) -> Column:
    return F.concat(F.lit(f"<{URN}"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(">"))


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", page: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    rows = with_kinds(pages.select(key, url, page), key, page)
    revisit = F.col("_refers").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("_payload")))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _urn(F.col(key))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.regexp_replace(url, r"[\x00-\x1f\x7f]", "")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest"))),
        _line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2("_block", 256))),
        _line("WARC-Refers-To", F.when(revisit, _urn(F.col("_refers")))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", F.octet_length("_block")),
        F.lit(CRLF), F.col("_block"),
    )
    out = rows.withColumn("_block", block).select(record.alias("value"))
    out.write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


class Damaged(ValueError):
    pass


def _digest_ok(named: str, data: bytes) -> bool:
    kind, _, value = named.partition(":")
    if kind.lower() not in ("sha1", "sha256", "md5"):
        return True  # no way to tell
    h = hashlib.new(kind.lower(), data)
    return value.strip().lower() == h.hexdigest() or value.strip().upper().rstrip("=") == base64.b32encode(h.digest()).decode().rstrip("=")


def _record(data: bytes, at: int) -> tuple[int, dict, bytes]:
    """(end, header fields, block) of the record that starts at ``at``; raises Damaged."""
    version = VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    fields, start = {}, version.end()
    while True:  # line by line, so a false start ends at its first line that is none, however far the next record is
        end = data.find(b"\r\n", start)
        if end < 0:
            raise Damaged("header without end")
        if end == start:
            break
        name, colon, value = data[start:end].decode("utf-8", "replace").partition(":")
        if not colon:
            raise Damaged("header line without colon")
        fields[name.strip().lower()] = value.strip()
        start = end + 2
    if not fields.get("content-length", "").isascii() or not fields.get("content-length", "").isdigit():
        raise Damaged("no content length")
    begin, size = start + 2, int(fields["content-length"])
    if begin + size > len(data):
        raise Damaged("block is cut off")
    if data[begin + size : begin + size + 4] != b"\r\n\r\n":
        raise Damaged("no separator after block")
    block = data[begin : begin + size]
    if not _digest_ok(fields.get("warc-block-digest", ""), block):
        raise Damaged("block digest differs")
    if fields.get("warc-type") == "response" and not _digest_ok(fields.get("warc-payload-digest", ""), payload_of(fields, block)):
        raise Damaged("payload digest differs")
    return begin + size + 4, fields, block


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """(all that comes out of the gzip member at ``at``, the byte after what was read, what went wrong)."""
    unzip, out, step = zlib.decompressobj(31), [], 1 << 16
    for i in range(at, len(data), step):
        part, before = data[i : i + step], unzip.copy()
        try:
            out.append(unzip.decompress(part))
        except zlib.error as e:
            # Once more byte by byte: what stands before the damage comes out.
            for k in range(len(part)):
                try:
                    out.append(before.decompress(part[k : k + 1]))
                except zlib.error:
                    return b"".join(out), i + k, f"gzip: {str(e)[-40:]}"
        if unzip.eof:
            return b"".join(out), i + len(part) - len(unzip.unused_data), None
    return b"".join(out), len(data), "gzip member is cut off"


def payload_of(fields: dict, block: bytes) -> bytes:
    if fields.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _plain(data: bytes, at: int) -> Iterator[tuple]:
    """One step: the record at ``at``; raises Damaged."""
    end, fields, block = _record(data, at)
    yield "record", at, end, None, fields, block


def _zipped(data: bytes, at: int) -> Iterator[tuple]:
    """One step: all records of the gzip member at ``at``, with the byte range of the member; raises Damaged if it gives none."""
    plain, end, wrong = _inflate(data, at)
    rows = list(salvage(plain, nested=True))
    if not plain and not wrong:
        yield "empty", at, end, None, None, None
        return
    if not any(r[0] == "record" for r in rows):
        raise Damaged(wrong or "no record in a gzip member")
    for kind, _, _, reason, fields, block in rows:
        if kind == "record" or not wrong:
            yield kind, at, end, reason and f"in a gzip member: {reason}", fields, block
    if wrong:
        raise Damaged(wrong)


def salvage(data: bytes, nested: bool = False) -> Iterator[tuple]:
    """("record", start, end, None, fields, block) and ("gap", start, end, reason, None, None), in order, covering all bytes."""
    at, n, lost, why = 0, len(data), None, None
    while at < n:
        found, failed = [], None
        try:
            for row in _zipped(data, at) if data[at : at + 3] == b"\x1f\x8b\x08" and not nested else _plain(data, at):
                found.append(row)
        except Damaged as e:
            failed = str(e)
        if found and lost is not None:
            yield "gap", lost, at, why, None, None
            lost = None
        yield from (row for row in found if row[0] != "empty")
        if failed is None:
            at = found[-1][2]
            continue
        if lost is None:
            lost, why = found[-1][2] if found else at, failed
        after = START.search(data, max(at + 1, found[-1][2] if found else 0))
        at = after.start() if after else n
    if lost is not None:
        yield "gap", lost, n, why, None, None


READ = pa.schema(
    [("path", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string()), ("type", pa.string()), ("record_id", pa.string()),
     ("uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
)


def _told(path: str, row: tuple, payloads: bool) -> tuple:
    kind, start, end, reason, fields, block = row
    if kind == "gap":
        return path, kind, start, end, reason, *[None] * 7
    body = payload_of(fields, block)
    if fields.get("warc-type") == "revisit":  # without payload: its length stands in the HTTP header that the record keeps
        said = re.search(rb"(?i)\ncontent-length:\s*(\d+)", block.partition(b"\r\n\r\n")[0])
        size, digest, body = int(said[1]) if said else None, fields.get("warc-payload-digest", "").partition(":")[2].lower(), None
    else:
        size, digest = len(body), hashlib.sha256(body).hexdigest()
    return path, kind, start, end, None, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), digest, size, body if payloads else None


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives below ``path``; records carry type, ids, digest, size and, if asked for, payload."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_.]*").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows):
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, READ, strict=True)], schema=READ)

        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, held = [], 0
                for row in salvage(content.as_py() or b""):
                    rows.append(_told(name.as_py(), row, payloads))
                    held += 500 + len(rows[-1][-1] or b"")
                    if held >= BATCH:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    kinds = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    return files.mapInArrow(run, ", ".join(f"`{f.name}` {kinds[f.type]}" for f in READ))


def gaps(found: DataFrame) -> DataFrame:
    """The quarantine log: path, first byte, byte after the last, and the check that failed."""
    return found.where("kind = 'gap'").select("path", "start", "end", "reason")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    path = shared_dir(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.regexp_extract(c, rf"<{URN}(-?\d+)>", 1).cast("long")
    return read(spark, path, payloads=False).where("kind = 'record'").select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        F.when(F.col("refers_to").isNotNull(), number("refers_to")).alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE strlen(body) >= 100 GROUP BY d)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND strlen(body) >= 100
"""
