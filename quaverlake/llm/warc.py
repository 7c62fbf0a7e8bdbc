"""WARC archives: a writer with revisit records and a salvage reader.

Writing. Spark's text writer ends every value with a blank line (CR LF CR LF), which is also how a WARC record ends, so each part file is a
WARC file of whole records and a task that is repeated replaces its files. A file holds at most `archive_bytes` before compression, or one
record that is longer; a compressed file is one gzip member, so damage to it costs the records from there to its end.
Of pages with equal payloads of at least `min_bytes` the one with the smallest id is a response, the others are revisits without
payload that name it.

Reading. A file is read as bytes and parsed member by member. Files may be plain or hold gzip members of one or more records.
Each record is checked: version line, header, length, the blank line after the block, and its digests. After a failed check the reader looks
for the next version line or gzip member that starts a valid record, goes on there, and logs the bytes between as a quarantined gap.

Defined results: a null payload counts as empty. A null id is written as an empty id and read back as null; it is never named by
a revisit while another page has the payload. Rows that repeat an id are records of their own; those that share the smallest id are all
responses. Extra columns are ignored. An empty table gives no records.
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

from .shared import cut, shared_dir, table

ARCHIVE_BYTES = 8 << 20
#: Records of up to 512 bytes are the first class of sizes.
LEAST_BITS = 9
END = "\r\n\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"


def base32(digest: Column) -> Column:
    """A SHA-1 of 40 hex digits in upper-case base32: eight groups of 20 bits, four letters each."""
    letters = F.lit(ALPHABET)
    parts = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        parts += [letters.substr(F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*parts)


def records(pages: DataFrame, id_col: str, payload_col: str, uri_col: str | None, min_bytes: int = 0) -> DataFrame:
    """One WARC record per page, without the blank line that ends it, as column `value`."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"),
        F.regexp_replace(F.coalesce(F.col(uri_col).cast("string"), F.lit("")), r"[\r\n]", "") if uri_col else F.lit(""),
    ).toDF("id", "payload", "uri")
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    # Only digests that occur again go to the other side of the join, where a hot digest is one row.
    again = rows.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.count("*").alias("copies"), F.min("id").alias("first")).where("copies > 1").select("digest", "first")
    rows = rows.join(again, "digest", "left")
    repeat = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    head = lambda kind, length, *more: F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.col("uri"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.col("digest")), *more, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), length, F.lit(END),
    )
    response = F.concat(head("response", F.col("bytes").cast("string")), F.col("payload"))
    revisit = head("revisit", F.lit("0"), F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    return rows.select(F.when(repeat, revisit).otherwise(response).alias("value"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", uri_col: str | None = "url", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, compression: str = "gzip") -> None:
    """`compression` is "gzip" (each file one member) or "none".

    Records are put into classes by size, each up to four times the one below. Inside a task the classes stand together, the largest first, and a file takes as many records of one
    class as fit into `archive_bytes` at the class's upper size. So no file of several records is larger than that, and no rows are shuffled for it."""
    size = F.octet_length("value").cast("long") + len(END)
    grade = F.greatest(F.lit(0), F.ceil((F.length(F.bin(size - 1)) - LEAST_BITS) / 2)).cast("int")
    each = F.greatest(F.lit(1), F.floor(F.lit(archive_bytes) / F.pow(F.lit(2.0), LEAST_BITS + 2 * F.col("grade")))).cast("long")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the row's number in its task
    rows = records(pages, id_col, payload_col, uri_col, min_bytes).withColumn("grade", grade).sortWithinPartitions(F.desc("grade"))
    rows = rows.withColumn("shard", F.floor(place / each))
    rows.write.partitionBy("grade", "shard").option("lineSep", END).option("compression", compression).text(path)


_VERSION = re.compile(rb"WARC/(?:0\.1[78]|1\.[01])\r\n")
_FIELD = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*(?:\r\n[ \t]+[^\r\n]*)*)\r\n")


def _record(data: bytes, at: int) -> tuple[dict, int, int, int] | str:
    """(header, block's start, block's end, next record) of the record at `at`, or what is wrong with it."""
    start = _VERSION.match(data, at)
    if not start:
        return "no version line"
    end = data.find(b"\r\n\r\n", start.end() - 2)
    if end < 0:
        return "header does not end"
    header, pos = {}, start.end()
    while pos < end + 2:
        field = _FIELD.match(data, pos)
        if not field:
            return "bad header line"
        header[field[1].decode("ascii").lower()] = field[2].decode("utf-8", "replace").strip()
        pos = field.end()
    size = header.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        return "no content length"
    begin, stop = end + 4, end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n" or stop + 4 > len(data):
        return "block is not followed by a blank line"
    if "warc-type" not in header or "warc-record-id" not in header:
        return "no type or id"
    digest = header.get("warc-payload-digest", "")
    if header["warc-type"] == "response" and digest.startswith("sha1:") and digest[5:] != base64.b32encode(hashlib.sha1(data[begin:stop]).digest()).decode():
        return "payload digest differs"
    return header, begin, stop, stop + 4


def _member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """A gzip member's content, as far as it can be inflated, its end, and what is wrong with it."""
    inflate, out = zlib.decompressobj(31), []
    try:
        for i in range(at, len(data), 1 << 16):
            out.append(inflate.decompress(data[i : i + (1 << 16)]))
            if inflate.eof:
                return b"".join(out), min(len(data), i + (1 << 16)) - len(inflate.unused_data), ""
    except zlib.error as wrong:
        return b"".join(out), at, f"bad member: {wrong}"
    return b"".join(out), at, "member is cut short"


def read_archive(data: bytes) -> Iterator[tuple]:
    """('record', start, end, header, block) and ('gap', start, end, reason, None), in the order of the bytes.

    Of a gzip member with several records each has the member's place. Of a damaged member the records before the damage are
    given, then the gap."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        found, stop = [], at
        if data[at : at + 2] == b"\x1f\x8b":
            inner, stop, wrong = _member(data, at)
            if inner:
                found = [(kind, at, stop if not wrong else at, what, block) for kind, _, _, what, block in read_archive(inner) if not wrong or kind == "record"]
        else:
            got = _record(data, at)
            wrong = got if isinstance(got, str) else ""
            if not wrong:
                stop = got[3]
                found = [("record", at, stop, got[0], data[got[1] : got[2]])]
        if gap is not None and (found or not wrong):
            yield "gap", gap, at, reason, None
            gap = None
        yield from found
        if wrong:
            if gap is None:
                gap, reason = at, wrong
            # The next place where a record can start; a false start fails its own check and the search goes on.
            plain, packed = _VERSION.search(data, at + 1), data.find(b"\x1f\x8b\x08", at + 1)
            at = min([x for x in (plain.start() if plain else -1, packed) if x >= 0], default=len(data))
        else:
            at = stop
    if gap is not None:
        yield "gap", gap, len(data), reason, None


def _read(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    names = ["path", "start", "end", "gap", "type", "record_id", "refers_to", "digest", "uri", "block"]
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.binary()]
    for batch in batches:
        for path, data in zip(batch.column("path"), batch.column("content"), strict=True):
            rows, size = [], 0
            for kind, start, end, what, block in read_archive(data.as_py()):
                h = what if kind == "record" else {}
                rows.append((path.as_py(), start, end, None if h else what, *(h.get(k) for k in ("warc-type", "warc-record-id", "warc-refers-to", "warc-payload-digest", "warc-target-uri")), block))
                size += end - start
                if size > limit:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, start, end, gap, type, record_id, refers_to, digest, uri, block): records, and for each quarantined gap a row
    whose `gap` is the reason. Archives are read whole, one at a time, so their size bounds a task's memory."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(_read, "path string, start long, end long, gap string, type string, record_id string, refers_to string, digest string, uri string, block binary")


def op10_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_warc(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    # A gap in archives that were just written is no result but a fault.
    whole = F.when(F.col("gap").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("gap in "), "path", F.lit(" at "), F.col("start").cast("string"), F.lit(": "), "gap")).cast("boolean"))
    back = cut(read_warc(spark, path).where(whole).select(number("record_id").alias("page_id"), F.octet_length("block").cast("long").alias("bytes"), F.substring("digest", 6, 32).alias("payload_digest"), F.col("type").alias("record_type"), number("refers_to").alias("refers_to")))
    # A revisit has the size of the response that it names; both are found by the digest.
    sizes = back.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("bytes").alias("payload_bytes"))
    return back.join(sizes, "payload_digest").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
