"""WARC writer and salvage reader.

Archives are written by Spark's own text writer, so they may live in any store: a row of text is a whole
record (header and payload, both UTF-8) and the line separator is the CRLF CRLF that ends a record. The
reader takes whole archive files as bytes. Each record is checked (version line, length, the CRLF CRLF after
the payload, payload digest if its algorithm is known). Where neither a version line (1.0 or 1.1) nor a valid gzip member stands,
or a check fails, the reader searches on for whichever comes first, recovers what follows and logs the byte gap that it
quarantined. An archive's first bytes decide nothing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import Scratch

_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MAGIC = b"\x1f\x8b\x08"
_NEXT = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
END = b"\r\n\r\n"
STEP = 1 << 16
DATE = "2020-01-01T00:00:00Z"
RECORDS_IN_FILE = 1000
#: Repeated digests up to this many are broadcast (about 100 bytes each); more are joined by shuffle.
FEW = 100_000
_LENGTH = re.compile(rb"(?mi)^Content-Length:[ \t]*([0-9]+)[ \t]*\r?$")
_FIELD = re.compile(rb"(?m)^([!-9;-~]+):[ \t]*(.*?)[ \t]*\r?$")


class Record(NamedTuple):
    start: int  # byte offset in the (decompressed) archive
    fields: dict[str, str]
    payload: bytes


class Gap(NamedTuple):
    start: int
    end: int
    why: str


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _differs(label: str, payload: bytes) -> bool:
    """Whether a labelled digest (base32 or hex; SHA-1 if it has no label) is not the payload's. Unknown algorithms cannot be checked."""
    name, colon, value = label.strip().rpartition(":")
    name = name.strip().lower().replace("-", "") if colon else "sha1"
    if colon and not re.fullmatch(r"[a-z0-9_]+", name):
        return True  # damaged
    if not value or name not in ("sha1", "sha256", "sha512", "md5"):
        return False
    own = hashlib.new(name, payload).digest()
    return value.upper().rstrip("=") != base64.b32encode(own).decode().rstrip("=") and value.lower() != own.hex()


def header(page_id: int | None, url: str | None, kind: str, payload: bytes, refers_to: int | None) -> bytes:
    """Header block of a record; a revisit carries the digest and length of the full payload and no content."""
    clean = lambda x: re.sub(r"[\r\n]+", " ", x)
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean(url or '')}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if kind == 'revisit' else len(payload)}"]
    return "\r\n".join(lines).encode() + END


def _check(data: bytes, at: int) -> tuple[Record, int] | str:
    """The record at ``at`` and where it ends, or what is wrong with it."""
    version = _VERSION.match(data, at)
    if not version:
        return "no version line"
    head = data.find(END, at)
    if head < 0:
        return "header without end"
    block = data[version.end() : head]
    if _VERSION.search(block):
        return "header runs into another record"
    length = _LENGTH.search(block)
    if not length:
        return "no length"
    start = head + len(END)
    stop = start + int(length[1])
    if data[stop : stop + len(END)] != END:
        return "length does not lead to a record's end"
    fields = {k.decode("latin-1").lower(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(block)}
    payload, coded = data[start:stop], False
    if _differs(fields.get("warc-block-digest", ""), payload):
        return "digest differs"
    if fields.get("content-type", "").lower().startswith("application/http"):  # the payload is the message's body
        top, _, payload = payload.partition(END)
        coded = b"transfer-encoding:" in top.lower()  # digests of such bodies are taken before or after decoding
    if fields.get("warc-type") != "revisit":
        if not coded and _differs(fields.get("warc-payload-digest", ""), payload):
            return "digest differs"
        if fields.get("warc-payload-length", str(len(payload))) != str(len(payload)):
            return "payload length differs"
    return Record(at, fields, payload), stop + len(END)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Records of a plain archive, and the gaps between them, in byte order."""
    at, bad, why = 0, None, ""
    while at < len(data):
        got = _check(data, at)
        if isinstance(got, str):
            bad, why = (at, got) if bad is None else (bad, why)
            found = _VERSION.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if bad is not None:
            yield Gap(bad, at, why)
            bad = None
        yield got[0]
        at = got[1]
    if bad is not None:
        yield Gap(bad, len(data), why)


def _member(data: bytes, at: int) -> tuple[list[Record | Gap], int] | str:
    """What the gzip member at ``at`` holds and where it ends, or what is wrong with it. Read in steps of ``STEP`` bytes, so that many members cost no more than their bytes."""
    member, view, raw, end = zlib.decompressobj(31), memoryview(data), [], at
    try:
        while not member.eof and end < len(data):
            raw.append(member.decompress(view[end : end + STEP]))
            end = min(end + STEP, len(data))
        raw.append(member.flush())
    except zlib.error as e:
        return str(e)
    if not member.eof:
        return "member without end"
    end -= len(member.unused_data)
    return [x._replace(start=at) if isinstance(x, Record) else Gap(at, end, x.why) for x in salvage(b"".join(raw))], end


def read_archive(data: bytes) -> Iterator[Record | Gap]:
    """Records of an archive, plain or of gzip members (one record each, or several), and the gaps between them, in byte order.

    Offsets are bytes of the archive as it is stored. In a gap, a member that holds no record is part of it.
    """
    at, bad, why = 0, None, ""
    while at < len(data):
        got = _member(data, at) if data.startswith(_MAGIC, at) else _check(data, at)
        if isinstance(got, tuple) and isinstance(got[0], Record):
            got = [got[0]], got[1]
        if isinstance(got, str) or (bad is not None and not any(isinstance(x, Record) for x in got[0])):
            bad, why = (at, got) if bad is None else (bad, why)
            found = _NEXT.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if bad is not None:
            yield Gap(bad, at, why)
            bad = None
        yield from got[0]
        at = got[1]
    if bad is not None:
        yield Gap(bad, len(data), why)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for page, url, html, first in zip(*(batch.column(c) for c in ("page_id", "url", "html", "first"))):
            page, first, payload = page.as_py(), first.as_py(), html.as_py() or b""
            old = first is not None and first != page
            out.append((header(page, url.as_py(), "revisit" if old else "response", payload, first if old else None) + (b"" if old else payload)).decode())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def write(pages: DataFrame, path: str, least_bytes: int = 0, compression: str = "none", records: int = RECORDS_IN_FILE, scratch: Scratch | None = None) -> None:
    """A record for each row of ``pages(page_id, url, html)``, equal payloads of at least ``least_bytes`` once.

    Only digests are grouped (pre-aggregated, so a payload that a third of all pages share is one row). With a
    ``scratch``, the repeated digests are written first and, if they are ``FEW`` at most, broadcast.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html"))
    rows = rows.withColumn("key", F.sha1("html"))
    firsts = rows.where(F.length("html") >= least_bytes).groupBy(F.col("key").alias("same")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = firsts.where("n > 1").drop("n")
    if scratch is not None:
        firsts = scratch.keep(firsts, "firsts")
        if firsts.limit(FEW + 1).count() <= FEW:  # at most some 10 MB: payloads stay where they are
            firsts = F.broadcast(firsts)
    rows = rows.join(firsts, F.col("key") == F.col("same"), "left")
    lines = rows.select("page_id", "url", "html", "first").mapInArrow(_records, "value string")
    lines.write.option("lineSep", END.decode()).option("maxRecordsPerFile", records).option("compression", compression).text(path)


def _id(uri: str | None) -> str | None:
    """A record's id without its angle brackets."""
    return uri.strip().removeprefix("<").removesuffix(">") if uri else None


def _length(x: Record) -> int:
    """Bytes of the full payload: a revisit names them."""
    named = x.fields.get("warc-payload-length", "")
    return int(named) if re.fullmatch(r"[0-9]{1,18}", named) else len(x.payload)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for name, content in zip(batch.column("path"), batch.column("content")):
            for x in read_archive(content.as_py()):
                if isinstance(x, Gap):
                    out.append((name.as_py(), "gap", x.start, x.end, x.why, None, None, None, None, None, None))
                else:
                    f = x.fields
                    out.append((name.as_py(), f.get("warc-type"), x.start, None, None, _id(f.get("warc-record-id")), f.get("warc-target-uri"), _length(x), f.get("warc-payload-digest", "").removeprefix("sha1:"), _id(f.get("warc-refers-to")), x.payload))
        names = ["path", "record_type", "start", "end", "why", "record_id", "url", "payload_bytes", "payload_digest", "refers_to", "payload"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        cols = list(zip(*out)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


READ_SCHEMA = "path string, record_type string, start long, end long, why string, record_id string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def read(spark, path: str) -> DataFrame:
    """Every record of the archives below ``path``, and a row of type ``gap`` for each quarantined byte range.

    Ids stay as they are written (``urn:page:7``, ``urn:uuid:...``). An archive is one value, so of 2 GB at most.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read, READ_SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read them back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Null html is an empty payload; empty payloads are deduplicated like any other. Rows that repeat the
    smallest page_id of their payload are all responses. A null page_id is never a group's smallest, unless
    it is alone. No pages: no archive records and an empty result.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    write(pages, at := scratch.path("archives"), scratch=scratch)
    sound = F.when(F.col("record_type") != "gap", True).otherwise(F.raise_error(F.concat(F.lit("a gap in an archive just written: "), "why")).cast("boolean"))
    kind = pages.schema["page_id"].dataType
    page = lambda c: F.regexp_extract(c, "^urn:page:(.*)$", 1).try_cast(kind)
    out = read(spark, at).where(sound).select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))
    out = scratch.keep(out, "out")
    scratch.clear(out)
    return out


#: DuckDB's form of ``round_trip``: base32 from the digest's 160 bits, five at a time.
ORACLE = r"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
 b AS (SELECT page_id, h, x, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', x[i]) - 1), 4, '0')), '') AS bits FROM p),
 d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda j: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[list_sum(list_transform(range(1, 6), lambda q: CASE WHEN bits[j * 5 + q] = '1' THEN 1 << (5 - q) ELSE 0 END))::BIGINT + 1]), '') AS digest FROM b),
 f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first, count(*) OVER (PARTITION BY x) AS n FROM d)
 SELECT page_id, strlen(h)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN n > 1 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n > 1 AND page_id <> first THEN first END AS refers_to FROM f"""
