"""A content-addressed archive of web records.

Two tables: `payloads` keeps the bytes of each distinct payload once under its SHA-256, and
`headers` the exact WARC/1.1 header block of every record. Reading verifies each payload against
its digest and gives the records back by a join on it. `segments` makes real archive segments of
them (gzip members, one a record) and `read_segments` reads such bytes into records again.

The record of the smallest page_id among equal payloads of MIN_SHARED bytes or more is the
response; the others are revisits of it. What decides that is small columns, which meet in joins
by digest that adaptive execution splits where one digest has very many records; payloads move
once into the archive, and once when records are rebuilt, each distinct one as a single row.

Every record has an id of its own: its page_id and its number in the archive. A url that holds a
line break is percent-encoded (`%`, CR and LF) and marked by a header line, so that it comes back
as it was; header lines end at CR LF alone.

Defined results: null html is an empty payload; a null url leaves out its header line, an empty
one leaves an empty line; rows without page_id are response records that nothing refers to; rows
that repeat a page_id and payload are two records of the same kind, their payload is stored once.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _io as io

MIN_SHARED = 100
_URN = "urn:corpusloom:page:"
_ENCODED = "X-Target-URI-Encoded"
_CHUNK = 1 << 14


def _line(name: str, value: Column) -> Column:
    """A header line, null where the value is."""
    return F.concat(F.lit(f"{name}: "), value)


def _id(page_id: Column, number: Column) -> Column:
    return F.concat(F.lit(f"<{_URN}"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), number.cast("string"), F.lit(">"))


def _swapped(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


_ESCAPES = [("%", "%25"), ("\r", "%0D"), ("\n", "%0A")]


def header_block(row_type: Column, page_id: Column, number: Column, url: Column, digest: Column, size: Column, refers_to: Column) -> Column:
    """The exact header block of a record; `refers_to` is the id of the response, null for others."""
    breaks = url.rlike("[\r\n]")
    lines = [
        F.lit("WARC/1.1"),
        _line("WARC-Type", row_type),
        _line("WARC-Record-ID", _id(page_id, number)),
        _line("WARC-Target-URI", F.when(breaks, _swapped(url, _ESCAPES)).otherwise(url)),
        F.when(breaks, F.lit(f"{_ENCODED}: 1")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        _line("WARC-Refers-To", refers_to),
        F.when(refers_to.isNotNull(), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        _line("Content-Length", F.when(refers_to.isNotNull(), F.lit("0")).otherwise(size.cast("string"))),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n")).cast("binary")


#: page_id and digest pairs, 44 bytes each, that are broadcast at most to the scan of payloads.
BROADCAST_ROWS = 250_000


def _known(rows: DataFrame) -> DataFrame:
    """rows, broadcast if a count shows that they are few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def write_archive(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers: header binary, payload_digest; payloads: payload_digest, payload), written into
    the shared folder and read from there."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    pages = pages.withColumn("payload_digest", F.sha2("payload", 256))
    index = pages.select("page_id", "url", "payload_digest", F.octet_length("payload").cast("long").alias("size"), F.monotonically_increasing_id().alias("number"))
    index = io.written(index, "warc-index")  # so the numbers stay
    lead = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "number")))
    shared = index.groupBy("payload_digest").agg(lead.alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = index.join(shared, "payload_digest", "left")
    later = F.col("page_id") != F.col("first.page_id")  # null without page_id, and if no other row has the payload
    revisit = later & (F.col("size") >= MIN_SHARED)
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    headers = joined.select(
        header_block(kind, F.col("page_id"), F.col("number"), F.col("url"), F.col("payload_digest"), F.col("size"), F.when(revisit, _id(F.col("first.page_id"), F.col("first.number")))).alias("header"),
        "payload_digest",
        "page_id",
        F.coalesce(later, F.lit(False)).alias("later"),
        (F.col("first").isNotNull() & (F.coalesce(F.col("number") != F.col("first.number"), F.lit(False)))).alias("again"),
        F.col("first.page_id").alias("first"),
    )
    headers = io.written(headers, "warc-headers")
    # of the rows that may hold a payload a second time, those of another page_id than the first's are
    # passed over; those of the first's own, or without any, are brought together
    others = headers.where("later").select("page_id", "payload_digest").distinct()
    kept = pages.where("page_id is not null").join(_known(others), ["page_id", "payload_digest"], "left_anti")
    twice = headers.where("again and not later and page_id is not null").select("page_id", "payload_digest").distinct()
    twice = _known(twice)
    once = kept.join(twice, ["page_id", "payload_digest"], "left_anti").select("payload_digest", "payload")
    named = headers.where("first is not null and page_id is null").select("payload_digest").distinct()
    lone = pages.where("page_id is null").join(_known(named), "payload_digest", "left_anti").select("payload_digest", "payload")
    several = kept.join(twice, ["page_id", "payload_digest"], "left_semi").select("payload_digest", "payload")
    payloads = io.written(once.union(several.union(lone).dropDuplicates(["payload_digest"])), "warc-payloads")
    return headers.select("header", "payload_digest"), payloads


def parsed(headers: DataFrame) -> DataFrame:
    """Fields of the header blocks (column `header`): page_id, url, payload_digest, record_type,
    refers_to; of a repeated line the first counts."""
    lines = F.split(F.decode("header", "UTF-8"), "\r\n")

    def value(name: str) -> Column:
        found = F.get(F.filter(lines, lambda x: F.startswith(x, F.lit(f"{name}: "))), 0)
        return F.substr(found, F.lit(len(name) + 3))

    def page(name: str) -> Column:
        number = F.regexp_extract(value(name), f"^<{_URN}(-?[0-9]+):[0-9]+>$", 1)
        return F.when(number != "", number).cast("long")

    url = value("WARC-Target-URI")
    digest = F.regexp_extract(value("WARC-Payload-Digest"), "^sha256:([0-9a-f]{64})$", 1)
    return headers.select(
        page("WARC-Record-ID").alias("page_id"),
        F.when(value(_ENCODED) == "1", _swapped(url, [(new, old) for old, new in reversed(_ESCAPES)])).otherwise(url).alias("url"),
        F.when(digest != "", digest).alias("payload_digest"),
        value("WARC-Type").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"),
        *headers.columns,
    )


def verified(payloads: DataFrame) -> DataFrame:
    """payloads with payload_bytes; reading one that doesn't have its digest is an error."""
    right = F.sha2("payload", 256) == F.col("payload_digest")
    size = F.when(right, F.octet_length("payload").cast("long")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("payload_digest"))).cast("long"))
    return payloads.withColumn("payload_bytes", size)


def records(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Every record as it was written, with its full payload: header fields, payload, payload_bytes."""
    return parsed(headers.select("header")).join(verified(payloads), "payload_digest", "left")


def rebuilt(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """header and payload of every record as it stands in an archive: revisits have no payload."""
    revisit = F.contains("header", F.lit(b"\r\nWARC-Refers-To: <"))
    own = headers.where(~revisit).join(verified(payloads), "payload_digest", "left").select("header", "payload")
    return own.union(headers.where(revisit).select("header", F.lit(b"").alias("payload")))


def read_back(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """The records of the archive rebuilt, written as WARC, read and verified: header fields of
    each with payload_bytes of its payload, for a revisit that of the record it refers to."""
    read = io.written(parsed(read_segments(segments(rebuilt(headers, payloads)))).drop("header"), "warc-read")
    sizes = read.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("body_bytes").alias("payload_bytes"))
    return read.drop("body_bytes").join(sizes, "payload_digest", "left")


def segments(found: DataFrame, most: int = 4 << 20) -> DataFrame:
    """Rows of `rebuilt` as archive segments: gzip members, one a record, about `most` bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for header, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if payload is None:
                    raise ValueError(f"no payload for {header!r}")
                held.append(gzip.compress(header + payload + b"\r\n\r\n", 6, mtime=0))
                size += len(held[-1])
                if size >= most:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)])], names=["segment"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)])], names=["segment"])

    return io.in_batches(found.select("header", "payload"), run, "segment binary")


def header_fields(header: bytes) -> dict[bytes, bytes]:
    """The lines `name: value` of a header block; of a repeated name the first."""
    out: dict[bytes, bytes] = {}
    for line in header.split(b"\r\n"):
        name, colon, value = line.partition(b": ")
        if colon:
            out.setdefault(name, value)
    return out


def parse_segment(segment: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header block, body) of each gzip member of a segment."""
    at, rest = 0, memoryview(segment)
    while at < len(rest):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(rest):
                raise ValueError("a segment ends within a record")
            parts.append(member.decompress(rest[at : at + _CHUNK]))
            at = min(len(rest), at + _CHUNK)
        at -= len(member.unused_data)
        raw = b"".join(parts)
        end = raw.index(b"\r\n\r\n") + 4
        size = int(header_fields(raw[:end])[b"Content-Length"])
        if raw[end + size :] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its header says")
        yield raw[:end], raw[end : end + size]


def read_segments(found: DataFrame) -> DataFrame:
    """header, body_bytes of each record of the segments; a response whose body doesn't have the
    digest that its header names is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment in batch.column(0):
                rows = list(parse_segment(segment.as_py()))
                for header, body in rows:
                    fields = header_fields(header)
                    named = fields.get(b"WARC-Payload-Digest", b"").removeprefix(b"sha256:")
                    if fields.get(b"WARC-Type") == b"response" and named != hashlib.sha256(body).hexdigest().encode():
                        raise ValueError(f"damaged record {fields.get(b'WARC-Record-ID')!r}")
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.binary()), pa.array([len(b) for _, b in rows], pa.int64())], names=["header", "body_bytes"])

    return io.in_batches(found.select("segment"), run, "header binary, body_bytes long")
