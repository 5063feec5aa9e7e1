"""Legacy archive converter: ARC files to WARC.

An ARC file starts with a version block that names its version and header fields; each record has one header line and
as many bytes as that declares. The converter reads both versions and synthesises what WARC asks for: record
identifiers, ISO timestamps, record types and payload digests. Equal payloads are written once, as the response with
the largest page id; the others become revisits. Archives are written and read by Spark, so that they can lie in any
store. A file starts with a warcinfo record, is rolled by its bytes, and has one gzip member for each record; it ends
with a zero byte, the padding that gzip readers skip.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import attach_groups, stage
from tracewright.storage import new_folder

#: Bytes of a synthetic legacy archive, and compressed bytes after which a written one is rolled.
ARC_BYTES, FILE_BYTES = 1 << 20, 32 << 20
#: Compression of the members: records are short, and higher levels save 5 % of the bytes for twice the time.
LEVEL = 1
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Header fields of the ARC versions.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
RECORD = "page_id long, uri string, ip string, warc_date string, mime string, http binary, payload binary, payload_bytes long, digest string"


# ------------------------------------------------------------------------------------------------ ARC


def _field(value: str) -> str:
    """A header field has no white space of its own."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value) or "-"


def arc_file(name: str, version: int, records: Iterable[tuple[str, str, str, str, bytes]]) -> bytes:
    """(url, ip, 14-digit date, content type, document) records -> an ARC file."""
    fields = f"{ARC_FIELDS[version]}\n".encode()
    intro = f"{version} 0 converter\n".encode() + fields
    start = f"filedesc://{name} 0.0.0.0 20000101000000 text/plain"
    out = [(f"{start} {len(intro)}\n" if version == 1 else f"{start} 200 - - 0 {name} {len(intro)}\n").encode(), intro, b"\n"]
    offset = sum(map(len, out))
    for url, ip, date, mime, document in records:
        middle = "" if version == 1 else f" 200 - - {offset} {name}"
        head = f"{_field(url)} {ip} {date} {_field(mime)}{middle} {len(document)}\n".encode()
        out += [head, document, b"\n"]
        offset += len(head) + len(document) + 1
    return b"".join(out)


def arc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and document of each record after the version block; a truncated file gives what it has whole."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at, names = 0, None
    while at < len(content):
        line_end = content.find(b"\n", at)
        if line_end < 0:
            return
        line = content[at:line_end].decode("utf-8", "replace").strip()
        if not line:  # records are set apart by line breaks
            at = line_end + 1
            continue
        values = line.split(" ")
        try:
            size = int(values[-1])
        except ValueError:
            return
        document = content[line_end + 1 : line_end + 1 + size]
        if size < 0 or len(document) < size:
            return
        at = line_end + 1 + size
        if values[0].startswith("filedesc:"):
            lines = document.decode("utf-8", "replace").splitlines()
            version = int(lines[0].split()[0]) if lines and lines[0].split()[:1] and lines[0].split()[0].isdigit() else 1
            names = (lines[1] if len(lines) > 1 else ARC_FIELDS.get(version, ARC_FIELDS[1])).split()
            continue
        names_here = names if names and len(names) == len(values) else ARC_FIELDS[2 if len(values) >= 10 else 1].split()
        yield dict(zip(names_here, values, strict=False)), document


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def iso_date(date: str) -> str:
    """ARC dates have 14 digits, older ones 12 or fewer."""
    d = (date + "00000101000000"[len(date) :]) if date.isdigit() and 4 <= len(date) < 14 else date
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z" if len(d) == 14 and d.isdigit() else "1970-01-01T00:00:00Z"


def convert(arcs: DataFrame) -> DataFrame:
    """ARC files (content binary) -> what their WARC records hold: see RECORD. page_id comes from the stored
    X-Page-Id line of the HTTP header, if there is one. Documents without an HTTP header are all payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.string())
        names = [x.split()[0] for x in RECORD.split(", ")]
        for b in batches:
            for content in b.column(0):
                rows = []
                for head, document in arc_records(content.as_py() or b""):
                    http, sep, payload = document.partition(b"\r\n\r\n") if document.startswith(b"HTTP/") else (b"", b"", document)
                    page = re.search(rb"(?im)^x-page-id: *(-?\d+)\r?$", http)
                    rows.append((int(page[1]) if page else None, head.get("URL", "-"), head.get("IP-address", "-"), iso_date(head.get("Archive-date", "")), head.get("Content-type", "-"), http, payload, len(payload), base32_sha1(payload)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return arcs.select("content").mapInArrow(run, RECORD)


def legacy_archives(pages: DataFrame, size: int = ARC_BYTES) -> DataFrame:
    """pages (page_id, url, html) as ARC files of about ``size`` bytes, the versions in turn: (content binary)."""

    def document(page_id: int | None, html: str | None) -> bytes:
        payload = (html or "").encode("utf-8", "surrogatepass")
        page = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
        return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{page}Content-Length: {len(payload)}\r\n\r\n".encode() + payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for b in batches:
            held, total = [], 0
            for k in range(b.num_rows + 1):
                if held and (k == b.num_rows or total >= size):
                    made += 1
                    yield pa.RecordBatch.from_arrays([pa.array([arc_file(f"legacy-{made}.arc", 1 + made % 2, held)], pa.binary())], names=["content"])
                    held, total = [], 0
                if k < b.num_rows:
                    page_id, url, html = (c[k].as_py() for c in b.columns)
                    date = f"2001{1 + (page_id or 0) % 12:02d}{1 + (page_id or 0) % 28:02d}{(page_id or 0) % 24:02d}0000"
                    held.append((url or "-", "0.0.0.0", date, "text/html", document(page_id, html)))
                    total += len(held[-1][-1])

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return picked.mapInArrow(run, "content binary")


# ------------------------------------------------------------------------------------------------ WARC


def record_uuid(page_id: Column) -> Column:
    """An identifier (UUID, version 8) that holds the page id; null has its own."""
    h = F.lpad(F.lower(F.hex(F.coalesce(page_id, F.lit(0).cast("long")))), 16, "0")
    last = F.when(page_id.isNull(), "a2c000000001").otherwise("a2c000000000")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8"), F.substring(h, 13, 3), F.lit("-a00"), F.substring(h, 16, 1), F.lit("-"), last)


def page_of(identifier: str) -> int | None:
    """The page id in a record identifier."""
    h = identifier.replace("-", "")
    if h.endswith("1"):
        return None
    value = int(h[:12] + h[13:16] + h[19], 16)
    return value - (1 << 64) if value >> 63 else value


def _lines(*fields: tuple[str, Column]) -> Column:
    return F.concat(F.lit("WARC/1.1\r\n"), *[x for name, value in fields for x in (F.lit(f"{name}: "), value, F.lit("\r\n"))])


def warc_record(refers_to: Column) -> Column:
    """Row of RECORD -> bytes of its WARC record, without the closing line breaks; a revisit has no payload."""
    block_size = lambda payload: (F.octet_length("http") + 4 + payload).cast("string")
    head = [("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), record_uuid(F.col("page_id")), F.lit(">"))), ("WARC-Date", F.col("warc_date")), ("WARC-Target-URI", F.col("uri")), ("WARC-IP-Address", F.col("ip"))]
    tail = [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), ("Content-Type", F.lit("application/http;msgtype=response"))]
    block = F.concat(F.lit(b"\r\n"), "http", F.lit(b"\r\n\r\n"))
    revisit = [("WARC-Type", F.lit("revisit")), ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), record_uuid(refers_to), F.lit(">")))]
    again = F.concat(_lines(*revisit, *head, *tail, ("Content-Length", block_size(F.lit(0)))).cast("binary"), block)
    whole = F.concat(_lines(("WARC-Type", F.lit("response")), *head, *tail, ("Content-Length", block_size(F.col("payload_bytes")))).cast("binary"), block, F.col("payload"))
    return F.when(refers_to.isNotNull(), again).otherwise(whole)


def write_archives(records: DataFrame, path: str, size: int = FILE_BYTES) -> None:
    """Records (of RECORD, with refers_to) as WARC files of about ``size`` bytes; a longer record has a file of its own."""
    fields = b"software: converter\r\nformat: WARC File Format 1.1\r\n"
    info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.UUID(int=0)}>\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(fields)}\r\n\r\n".encode() + fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = lambda record: gzip.compress(record + END.encode(), LEVEL, mtime=0)
        held, total = [], 0
        roll = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join([member(info), *held])], pa.binary())], names=["value"])
        for b in batches:
            for record in b.column(0):
                part = member(record.as_py())
                if held and total + len(part) > size:
                    yield roll()
                    held, total = [], 0
                held.append(part)
                total += len(part)
        if held:
            yield roll()

    files = records.select(warc_record(F.col("refers_to")).alias("value")).mapInArrow(run, "value binary")
    files.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def members(content: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The members of a gzip file, one after another; a plain file is one. Bytes behind a torn member are left out."""
    view, at = memoryview(content), 0
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while view[at : at + 2] == b"\x1f\x8b":
        one, parts = zlib.decompressobj(31), []
        while not one.eof and at < len(view):
            parts.append(one.decompress(view[at : at + step]))
            at = min(at + step, len(view)) - len(one.unused_data)
        yield b"".join(parts)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record, by declared lengths."""
    for part in members(content):
        at = 0
        while at < len(part):
            stop = part.find(b"\r\n\r\n", at)
            if stop < 0:
                break
            lines = part[at:stop].decode("utf-8", "replace").split("\r\n")
            head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = int(head["content-length"])
            yield head, part[stop + 4 : stop + 4 + size]
            at = stop + 4 + size + len(END)


def read_archives(spark, path: str) -> DataFrame:
    """WARC files -> page_id, uri, payload_bytes, payload_digest, record_type, refers_to, sound.

    ``sound``: a response's payload has the declared length and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
        names = ["page_id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound"]
        for b in batches:
            for content in b.column(0):
                rows = []
                for head, block in warc_records(content.as_py()):
                    if head["warc-type"] not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    declared = re.search(rb"(?im)^content-length: *(\d+)", http)
                    size = int(declared[1]) if declared else len(payload)
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    ident = lambda name: page_of(head[name][len("<urn:uuid:") : -1])  # noqa: B023, E731
                    again = head["warc-type"] == "revisit"
                    if not again:
                        size, stated = len(payload), size
                    rows.append((ident("warc-record-id"), head["warc-target-uri"], size, digest, head["warc-type"], ident("warc-refers-to") if again else None, again or (size == stated and base32_sha1(payload) == digest)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, sound boolean")


def revisits(records: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, digest, payload_bytes) -> (page_id, digest, refers_to) of the records that repeat a payload of
    ``least`` bytes or more. The largest page_id is the response; repeated rows of it all are."""
    rows = stage(records.where(F.col("payload_bytes") >= least).select("page_id", "digest"), "warc-digests")
    groups = rows.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies"))
    groups = stage(groups.where("copies > 1"), "warc-groups")
    found = attach_groups(rows, groups, "digest", "copies", rows.count())
    return found.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def archive(pages: DataFrame, least: int = 0, path: str | None = None) -> DataFrame:
    """Convert pages (page_id, url, html) by way of legacy archives, write WARC files, and read them back.

    One row per page: page_id, uri, payload_bytes, payload_digest, record_type, refers_to, sound. Null pages have an
    empty payload. Null page ids come before all others, so they revisit any other copy; of repeated rows all are the
    response. A page of any length is one record, held whole by one task. An empty table gives no rows; other columns
    are ignored. Without ``path`` the archives lie in the shared folder until ``storage.clear_staged``.
    """
    spark = pages.sparkSession
    path = path or new_folder(spark, "warc")
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    # The digests that decide on revisits need no archive; they are the same bytes.
    digests = pages.select(F.col("page_id").cast("long").alias("page_id"), base32(F.sha1(payload)).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    again = stage(revisits(digests, least), "warc-revisits").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to")
    records = convert(legacy_archives(pages))
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    records = records.join(again.hint("shuffle_hash"), same, "left").drop("_id", "_digest")
    write_archives(records, path)
    return read_archives(spark, path)


def base32(hexed: Column) -> Column:
    """40 hex digits -> 32 base32 digits: five hex digits are four of base 32."""
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
