"""WARC archives of web pages: one gzip member a record, written by Spark and read back front to back.

Writing: every page becomes a ``response`` record whose block is an HTTP header and the page's bytes. Of pages with
equal bytes, ``MIN_REVISIT`` or more of them, the one with the largest id keeps them; the others are ``revisit``
records, which hold the header only and refer to it. Each record is one gzip member, and members are written as rows
of Spark's text source, so archives reach any store Spark writes to and a lost task's files are never seen. The text
source ends a row with a separator; a member's last byte is the top byte of its length, zero below 16 MiB, so it is
left to the separator. A longer record is followed by an empty member, which ends in zero too. The files are thus
plain WARC archives. A task starts a new archive after ``max_bytes``; each begins with a ``warcinfo`` record.

Reading: an archive is read by one task, member after member. A member is unpacked in slices, its header parsed, as
many bytes as ``Content-Length`` says are taken, and the digests of block and payload are computed on the way. What
doesn't unpack, is cut off, is framed wrongly or isn't a record gives a row with ``error``, and reading goes on at the
next member that starts a record. A wrong digest gives ``verified`` false. Memory: one archive and one record.

Equal pages are found by length and SHA-256, summed in each task before they meet, so a page copied millions of times
is one row; the join back is on plain scans, which Spark splits where a page is frequent, or broadcasts if the
repeated pages are few.

Defined cases: a null page is empty; empty and short pages are all responses; a null id is smaller than any other and
reads back as null, like an empty one; of rows that repeat page and id, one is the response; a null address is left
out, and white space and control characters in an address are percent-encoded; other columns are not read; an empty table gives
no records.
"""

from __future__ import annotations

import base64
import hashlib
import time
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pvgrid.llm.common import map_arrow, stage

#: Pages of fewer bytes are never revisits.
MIN_REVISIT = 1000
#: A task starts a new archive after so many packed bytes.
MAX_ARCHIVE = 32 << 20

SLICE = 1 << 16
MAX_HEADER = 1 << 20
BATCH_BYTES = 8 << 20
MAGIC = b"\x1f\x8b\x08"
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
KEEP = "".join(chr(c) for c in range(0x21, 0x7F))

RECORDS = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("verified", T.BooleanType()),
    T.StructField("error", T.StringType())])


def pack(record: bytes) -> bytes:
    """A record as one gzip member."""
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(record) + gz.flush()


EMPTY = pack(b"")


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _hex(digest: str) -> str:
    """A SHA-1 digest field as hexadecimal digits; archives hold either base 32 or hexadecimal ones."""
    value = digest.split(":", 1)[-1].strip()
    if len(value) == 32:
        try:
            return base64.b32decode(value.upper()).hex()
        except ValueError:
            pass
    return value.lower()


def make_record(kind: str, record_id: str, date: str, block: bytes, content_type: str, **fields: str | None) -> bytes:
    """A WARC record; further fields are named with underscores for dashes."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, "WARC-Block-Digest": _digest(block),
            **{"-".join(["WARC", *k.split("_")]): v for k, v in fields.items() if v is not None},
            "Content-Type": content_type, "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.0\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_urn(page_id: object, row: int) -> str:
    """Name of a page's record; the row tells apart pages that repeat an id."""
    return f"urn:page:{'' if page_id is None else quote(str(page_id), safe='-')}:{row}"


def page_record(page_id: object, row: int, url: str | None, html: bytes, date: str, keep: tuple | None) -> bytes:
    """The record of a page; ``keep`` is (id, row) of the page with equal bytes that keeps them, if it is another."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html))
    fields = {"Target_URI": url and quote(url.encode(), safe=KEEP), "Payload_Digest": _digest(html)}
    kind = "application/http; msgtype=response"
    if keep is None:
        return make_record("response", page_urn(page_id, row), date, http + html, kind, **fields)
    return make_record("revisit", page_urn(page_id, row), date, http, kind, Profile=REVISIT,
                       Refers_To=f"<{page_urn(*keep)}>", **fields)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                   max_bytes: int = MAX_ARCHIVE, date: str | None = None) -> None:
    """Write the pages as WARC archives below ``path``."""
    date = date or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    rows = stage(pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"),
                              F.monotonically_increasing_id().alias("row")), "pages")
    # a short page's key is its row, so that it meets no other
    rows = rows.withColumn("key", F.when(
        F.octet_length("body") >= MIN_REVISIT, F.concat_ws(":", F.octet_length("body"), F.sha2("body", 256)))
        .otherwise(F.col("row").cast("string")))
    best = F.max(F.struct("id", (-F.col("row")).alias("back")))
    groups = stage(rows.select("id", "row", "key").groupBy("key").agg(F.count("*").alias("n"), best.alias("best")).where("n > 1")
                   .select("key", F.col("best.id").alias("keep_id"), (-F.col("best.back")).alias("keep_row")), "page-groups")
    members = rows.join(groups, "key", "left").select("id", "row", "url", "body", "keep_id", "keep_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, size, first = -1, max_bytes, 0
        for batch in batches:
            numbers, packed = [], []
            for page_id, row, url, html, keep_id, keep_row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= max_bytes:
                    archive, size = archive + 1, 0
                    first = row if archive == 0 else first
                    info = make_record("warcinfo", f"urn:archive:{first}:{archive}", date, b"format: WARC File Format 1.0\r\n",
                                       "application/warc-fields")
                    numbers.append(archive)
                    packed.append(pack(info)[:-1])
                keep = None if keep_row is None or keep_row == row else (keep_id, keep_row)
                record = page_record(page_id, row, url, html, date, keep)
                member = pack(record)
                if member[-1]:
                    member += EMPTY
                numbers.append(archive)
                packed.append(member[:-1])
                size += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(packed, pa.binary())], ["archive", "member"])

    made = map_arrow(members, run, T.StructType([T.StructField("archive", T.IntegerType()), T.StructField("member", T.BinaryType())]))
    (made.select("archive", F.col("member").cast("string").alias("value"))
     .write.partitionBy("archive").option("lineSep", "\0").option("compression", "none").text(path))


class BadRecord(ValueError):
    """What stands at a place of an archive is not a whole record."""


class _Member:
    """One gzip member, unpacked in slices."""

    def __init__(self, data: memoryview, at: int) -> None:
        self.data, self.at, self.gz, self.rest = data, at, zlib.decompressobj(31), b""
        self.ready = bytearray()

    def _more(self) -> bool:
        """Unpack another slice; whether the member goes on."""
        while not self.gz.eof:
            if not self.rest:
                self.rest = self.data[self.at:self.at + SLICE]
                self.at += len(self.rest)
                if not self.rest:
                    raise BadRecord("cut off")
            try:
                out = self.gz.decompress(self.rest, SLICE)
            except zlib.error as wrong:
                raise BadRecord("does not unpack") from wrong
            if self.gz.eof:
                self.at -= len(self.gz.unused_data)
            self.rest = self.gz.unconsumed_tail
            if out:
                self.ready += out
                return True
        return False

    def until(self, mark: bytes, most: int) -> bytes:
        """The bytes up to and with ``mark``; empty if the member holds none at all."""
        seen = 0
        while (found := self.ready.find(mark, seen)) < 0:
            seen = max(0, len(self.ready) - len(mark) + 1)
            if len(self.ready) > most:
                raise BadRecord("header too long")
            if not self._more():
                if self.ready:
                    raise BadRecord("header without end")
                return b""
        return self._take(found + len(mark))

    def _take(self, n: int) -> bytes:
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out

    def slices(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes."""
        while n:
            if not self.ready and not self._more():
                raise BadRecord("shorter than its length says")
            out = self._take(min(n, len(self.ready)))
            n -= len(out)
            yield out

    def finish(self) -> None:
        """Only the end of a record may follow."""
        while len(self.ready) <= 4 and self._more():
            pass
        if self.ready != b"\r\n\r\n":
            raise BadRecord("longer than its length says")


def _fields(head: bytes) -> dict[str, str]:
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return fields


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and text.isascii() and text.isdigit() else None


def read_record(member: _Member, payloads: bool) -> tuple | None:
    """(type, id, uri, refers_to, payload, payload bytes, payload digest, verified) of a member; None if it is empty."""
    head = member.until(b"\r\n\r\n", MAX_HEADER)
    if not head:
        return None
    if not head.startswith(b"WARC/"):
        raise BadRecord("no record")
    fields = _fields(head)
    length = _number(fields.get("content-length"))
    if length is None:
        raise BadRecord("no length")
    http = fields.get("content-type", "").lower().startswith("application/http")
    whole, body, kept, size, lead = hashlib.sha1(), hashlib.sha1(), bytearray(), 0, bytearray()
    in_lead = http
    for piece in member.slices(length):
        whole.update(piece)
        if in_lead:
            seen = max(0, len(lead) - 3)
            lead += piece
            end = lead.find(b"\r\n\r\n", seen)
            if end < 0:
                continue
            in_lead, piece = False, bytes(lead[end + 4:])
            del lead[end + 4:]
        body.update(piece)
        size += len(piece)
        if payloads:
            kept += piece
    member.finish()
    kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest")
    verified = "warc-block-digest" not in fields or _hex(fields["warc-block-digest"]) == whole.hexdigest()
    if kind == "revisit":  # the payload stands in the record it refers to
        size, kept = _number(_fields(bytes(lead)).get("content-length")), None
        found = digest and _hex(digest)
    else:
        found = body.hexdigest()
        verified = verified and (digest is None or _hex(digest) == found)
    return (kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"),
            bytes(kept) if payloads and kept is not None else None, size, found, verified)


def read_archive(data: memoryview, payloads: bool = True) -> Iterator[tuple]:
    """(offset, length, record fields ..., error) of an archive's members, front to back."""
    at, lost = 0, False
    while at < len(data):
        member = _Member(data, at)
        try:
            record = read_record(member, payloads)
        except BadRecord as wrong:
            if not lost:
                yield (at, None, *[None] * 7, False, str(wrong))
            lost, at = True, _next_member(data, at + 1)
            continue
        if record:
            yield (at, member.at - at, *record, None)
        lost, at = False, member.at


def _next_member(data: memoryview, at: int) -> int:
    """Where the next bytes stand that may start a member, or the end."""
    while at < len(data):
        part = bytes(data[at:at + SLICE])
        found = part.find(MAGIC)
        if found >= 0:
            return at + found
        at += max(1, len(part) - len(MAGIC) + 1)
    return len(data)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below ``path``, of this or another writer; see ``RECORDS`` for the columns.

    ``length`` is the packed one. A revisit's payload is null, its number of bytes and digest are those of the page
    it refers to. ``payloads=False`` leaves all payloads null.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(RECORDS)
        rows, size = [], 0
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                for record in read_archive(memoryview(content.as_buffer()), payloads):
                    rows.append((name.as_py(), *record))
                    size += 200 + len(record[6] or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return map_arrow(files, run, RECORDS)


def page_of(record_id: str) -> Column:
    """The page's id, as text, from the name of its record."""
    text = F.regexp_extract(record_id, "^<urn:page:([^:]*):", 1)
    return F.when(text != "", F.url_decode(text))


def page_records(pages: DataFrame, path: str) -> DataFrame:
    """Write the pages below ``path`` and read them back: page, payload_bytes, payload_digest, record_type, refers_to.

    A record that can't be read or whose digests don't fit fails the job.
    """
    write_archives(pages, path)
    found = read_archives(pages.sparkSession, path, payloads=False)
    sound = F.when(F.col("error").isNull() & F.col("verified"), F.col("record_type")).otherwise(
        F.raise_error(F.concat(F.lit("bad record in "), "archive", F.lit(" at "), F.col("offset"))))
    return (found.withColumn("record_type", sound).where("record_type IN ('response', 'revisit')")
            .select(page_of("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                    page_of("refers_to").cast("long").alias("refers_to")))
