"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

The reader checks every member and record (framing, lengths, digest). After a
failed check it searches for the next place where a gzip member or a version line
begins a valid record, goes on from there, and logs the bytes between as a
quarantined gap. What a damaged member still inflates to is searched in the same
way by version lines: its valid records are kept beside the gap. Archives are read whole by Spark, a file a row; the writer keeps
files small by the number of records in each.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import python_ready, saved

#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 1000
RECORDS_A_FILE = 20_000
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GZIP = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[0-9]\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[0-9]\r\n")
#: Bytes of a member that are inflated at once. What a member's last slice holds of the next is copied, so slices are small.
_CHUNK = 16_384
#: A gzip member of nothing, which Spark's text writer puts between records.
_EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003") + bytes.fromhex("0300") + bytes(8)


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "about:blank")
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, compress: bool = True, date: str = DATE, records: int = RECORDS_A_FILE) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) to WARC files under ``path``.

    Of rows whose payloads are equal and have at least 1,000 bytes, those with the
    largest page_id are responses and the others revisit it; all other rows are
    responses. A null html is an empty payload, a null url ``about:blank``; a null
    page_id never is the largest, and revisits if its payload has a response.
    Compressed archives have a gzip member for each record (and empty ones between).
    """
    python_ready(pages.sparkSession)
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").alias("page_id"), F.col("url").alias("url"), html.alias("payload"), F.sha1(html).alias("digest"))
    # payloads are equal by digest, length and a second hash
    rows = rows.withColumn("hash", F.xxhash64("payload")).withColumn("length", F.octet_length("payload"))
    long = rows.where(F.col("length") >= LEAST_REVISIT)
    firsts = long.groupBy("digest", "hash", "length").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    firsts = saved(firsts.drop("n").withColumnsRenamed({"digest": "_digest", "hash": "_hash", "length": "_length"}), "first")  # once written, Spark knows its size and picks the join by it
    rows = rows.join(firsts, (rows.digest == firsts._digest) & (rows.hash == firsts._hash) & (rows.length == firsts._length), "left")
    rows = rows.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                record = _record(*row, date)
                if compress:
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    record = z.compress(record) + z.flush()
                else:
                    record = record[:-4]  # the writer ends each with the blank lines
                out.append(record)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    end = _EMPTY_MEMBER if compress else b"\r\n\r\n"
    made = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    made.write.option("lineSep", end.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", records).text(path)


@dataclass
class Found:
    """A record, or a gap if ``reason`` is set, at bytes start to end of a file."""

    start: int
    end: int
    reason: str | None = None
    headers: dict[str, str] | None = None
    payload: bytes = b""
    payload_bytes: int = 0
    digest: str | None = None


class Damaged(Exception):
    def __init__(self, why: str, found: list[Found] | None = None, until: int = 0) -> None:
        super().__init__(why)
        #: Valid records of a gzip member that is damaged, and where its inflation stopped.
        self.found, self.until = found or [], until


def _parsed(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``."""
    if not _VERSION.match(data, at):
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Damaged("no end of headers")
    headers = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("a header without a colon")
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"[0-9]{1,15}", headers.get("content-length", "")):
        raise Damaged("no length")
    start, end = stop + 4, stop + 4 + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("the block doesn't end where its length says")
    return headers, data[start:end], end + 4


def _stated(digest: str | None) -> str | None:
    """A SHA-1 digest of a header in hex; headers have it in hex or in base 32. Other digests are left unchecked."""
    name, _, value = (digest or "").partition(":")
    if name.strip().lower() != "sha1":
        return None
    value = value.strip()
    if re.fullmatch(r"[0-9A-Fa-f]{40}", value):
        return value.lower()
    try:
        return base64.b32decode(value.upper()).hex() if len(value) == 32 else None
    except binascii.Error:
        return None


def _checked(headers: dict[str, str], block: bytes, start: int, end: int) -> Found:
    whole = _stated(headers.get("warc-block-digest"))
    if whole and whole != hashlib.sha1(block).hexdigest():
        raise Damaged("the block doesn't have its digest")
    head, blank, payload = block.partition(b"\r\n\r\n")
    if not headers.get("content-type", "").startswith("application/http"):
        head, payload = b"", block
    length = re.search(rb"(?im)^content-length:\s*([0-9]{1,15})\s*$", head)
    stated = _stated(headers.get("warc-payload-digest"))
    if headers.get("warc-type") == "revisit":
        return Found(start, end, None, headers, b"", int(length[1]) if length else 0, stated)
    actual = hashlib.sha1(payload).hexdigest()
    if stated and stated != actual:
        raise Damaged("the payload doesn't have its digest")
    return Found(start, end, None, headers, payload, len(payload), actual)


def _within(inner: bytes, start: int, end: int) -> list[Found]:
    """The records of a member's inflated bytes, and a gap for each run of them that is damaged."""
    out, i, bad = [], 0, False
    while i < len(inner):
        try:
            headers, block, stop = _parsed(inner, i)
            found = _checked(headers, block, start, end)
        except Damaged as e:
            if not bad:
                out.append(Found(start, end, str(e)))
            bad = True
            further = _VERSION.search(inner, i + 1)
            i = further.start() if further else len(inner)
            continue
        out.append(found)
        i, bad = stop, False
    return out


def _before_error(data: bytes, at: int) -> tuple[bytes, int]:
    """What a corrupt member inflates to before its error, and where that is."""
    z, out = zlib.decompressobj(31), []
    while at < len(data):
        kept, chunk = z.copy(), data[at : at + _CHUNK]
        try:
            out.append(z.decompress(chunk))
        except zlib.error:
            for i in range(len(chunk)):
                try:
                    out.append(kept.decompress(chunk[i : i + 1]))
                except zlib.error:
                    return b"".join(out), at + i
        at += len(chunk)
    return b"".join(out), at


def _at(data: bytes, at: int) -> tuple[list[Found], int]:
    """The records and gaps of the member or record that begins at ``at``, and its end."""
    if data.startswith(_GZIP, at):
        z, why, view = zlib.decompressobj(31), None, memoryview(data)
        parts, end = [], at
        try:
            while not z.eof and end < len(data):
                parts.append(z.decompress(view[end : end + _CHUNK]))
                end = min(end + _CHUNK, len(data))
            inner = b"".join(parts)
            end -= len(z.unused_data)
            if not z.eof:
                why = "gzip: the member has no end"
        except zlib.error as e:
            why = f"gzip: {e}"
            inner, end = _before_error(data, at)
        found = _within(inner, at, end)
        valid = [f for f in found if f.reason is None]
        if why:
            # a checksum that fails while each record passes: the damage is where no other check sees it
            hidden = " check" in why and len(valid) == len(found)
            raise Damaged(why, [] if hidden else valid, end)
        if found and not valid:
            raise Damaged(found[0].reason)
        return found, end
    headers, block, end = _parsed(data, at)
    return [_checked(headers, block, at, end)], end


def salvage(data: bytes) -> Iterator[Found]:
    """All valid records of an archive's bytes, and the gaps between them, in order.

    Records of one member share its place; those of a damaged one follow its gap.
    """
    at, bad, why = 0, None, ""
    inside: list[Found] = []
    until = 0

    def gap(end: int) -> Iterator[Found]:
        yield Found(bad, end, why)
        for f in inside:
            f.end = end
            yield f

    while at < len(data):
        try:
            found, end = _at(data, at)
        except Damaged as e:
            if bad is None:
                bad, why = at, str(e)
            if e.found and at >= until:
                inside += e.found
                until = e.until
            further = _START.search(data, at + 1)
            at = further.start() if further else len(data)
            continue
        # an empty member within a gap stays in it, and so does a stored record that was inflated already
        again = at < until and any((f.headers, f.digest) == (x.headers, x.digest) for f in found[:1] for x in inside)
        if bad is not None and (not found or again):
            at = end
            continue
        if bad is not None:
            yield from gap(at)
            bad, inside, until = None, [], 0
        yield from found
        at = end
    if bad is not None:
        yield from gap(len(data))


_OUT = "path string, start long, `end` long, gap string, record_type string, record_id string, refers_to string, target_uri string, payload_bytes long, payload_digest string, payload binary"


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records and gaps of all archives under ``path``, a row each.

    ``gap`` is null for a record; for quarantined bytes it says which check
    failed first, and the other columns but path, start and end are null. A
    revisit's payload_bytes and payload_digest are those of the full payload, from
    its headers. No file, or empty files, give no rows.
    """
    python_ready(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []

                def made(rows: list[tuple]) -> pa.RecordBatch:
                    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]
                    names = ["path", "start", "end", "gap", "record_type", "record_id", "refers_to", "target_uri", "payload_bytes", "payload_digest", "payload"]
                    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
                    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

                for f in salvage(data.as_py()):
                    h = f.headers
                    if h is None:
                        rows.append((name, f.start, f.end, f.reason, *[None] * 7))
                    else:
                        rows.append((name, f.start, f.end, None, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), f.payload_bytes, f.digest, f.payload if payload else None))
                    if len(rows) >= 1000:
                        yield made(rows)
                        rows = []
                yield made(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content").where("length > 0")
    return files.mapInArrow(run, _OUT)
