"""WARC archives of pages: segmented records written as text files, read back by segment reassembly.

Writing.  A page becomes an HTTP message with a chunked body in a WARC/1.1 ``response``
record.  A block longer than ``segment_bytes`` is cut: the first part is the response, the others are ``continuation``
records that name it as their origin; parts are numbered from 1 and the last tells the total length.
Of pages with equal payloads of at least ``least_revisit`` bytes only those with the largest
``page_id`` keep the payload; the others are ``revisit`` records, a head of headers without a body.
Archives go through Spark's text writer, whose line ends close each record, so its committer makes retries safe.

Reading.  Archives are cut into records by tasks of one file each.  Whole records are decoded where they are; parts
are grouped by the identifier of their origin, ordered by number, checked against the
total length, joined, and only then is the chunked framing undone, as a chunk may lie across parts.

Defined cases: null html is an empty payload; a null ``page_id`` counts as below every
other and is stored as no field at all; rows with one ``page_id`` are records of their own, and if they are the largest of equal
payloads all of them are responses; null or multi-line ``url`` is stored without its line ends or left out; an empty
table gives no record; other columns are ignored.  A record that lacks a part or whose length, framing or digest is wrong comes
back with its ``error`` and a null payload; bytes that are no WARC record raise ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, give_back, small_batches

# Fixed values of the format.
VERSION, END = b"WARC/1.1", b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = "record_id string, record_type string, origin_id string, segment int, total long, page_id long, url string, refers_to long, digest string, block binary"
RECORD_ARROW = pa.schema(
    [("record_id", pa.string()), ("record_type", pa.string()), ("origin_id", pa.string()), ("segment", pa.int32()), ("total", pa.int64())]
    + [("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("block", pa.binary())]
)
PAGE_SCHEMA = "record_id string, page_id long, url string, record_type string, refers_to long, n_segments int, payload_bytes long, payload_digest string, payload binary, error string"
PAGE_ARROW = pa.schema(
    [("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("n_segments", pa.int32())]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string())]
)


def payload_of(html: Column) -> Column:
    return F.coalesce(html.cast("string"), F.lit("")).cast("binary")


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(piece), piece) for piece in (payload[at : at + size] for at in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions of a chunk and trailing fields are passed over."""
    out, at, view = [], 0, memoryview(body)
    while True:
        end = body.find(END, at)
        if end < 0:
            raise ValueError("a chunk's size is cut off")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        if size < 0:
            raise ValueError("a chunk's size is negative")
        at = end + 2
        if size == 0:
            while (end := body.find(END, at)) != at:
                if end < 0:
                    raise ValueError("trailing fields are cut off")
                at = end + 2
            if end + 2 != len(body):
                raise ValueError("bytes after the last chunk")
            return b"".join(out)
        if body[at + size : at + size + 2] != END:
            raise ValueError("a chunk is shorter or longer than its size")
        out.append(view[at : at + size])
        at += size + 2


def sha1_text(payload: bytes) -> str:
    """The digest as archives write it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record but for its last line end, which the text writer adds."""
    head = [VERSION, *[f"{name}: {value}".encode() for name, value in fields if value is not None], b"Content-Length: %d" % len(block)]
    return END.join([*head, b"", block]) + END


def _one_line(url: str | None) -> str | None:
    return " ".join(url.split()) or None if url is not None else None


def _records(segment_bytes: int, chunk_bytes: int, date: str):
    def page(number: int, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> Iterator[bytes]:
        name = lambda k: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{number}/{k}')}>"
        shared = [("WARC-Date", date), ("WARC-Target-URI", _one_line(url)), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", sha1_text(payload)), ("Content-Type", "application/http;msgtype=response")]
        if revisit:
            head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
            yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", name(1)), ("WARC-Profile", PROFILE), ("WARC-Refers-To-Page-ID", refers_to), *shared], head)
            return
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
        if len(block) <= segment_bytes:
            yield record([("WARC-Type", "response"), ("WARC-Record-ID", name(1)), *shared], block)
            return
        starts = range(0, len(block), segment_bytes)
        for k, at in enumerate(starts, 1):
            own = [("WARC-Type", "response"), ("WARC-Record-ID", name(1))] if k == 1 else [("WARC-Type", "continuation"), ("WARC-Record-ID", name(k)), ("WARC-Segment-Origin-ID", name(1))]
            last = [("WARC-Segment-Total-Length", len(block))] if k == len(starts) else []
            yield record([*own, ("WARC-Segment-Number", k), *last, *(shared if k == 1 else shared[:2])], block[at : at + segment_bytes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = [], 0
        for batch in batches:
            for number, page_id, url, payload, refers_to, revisit in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
                for one in page(number, page_id, url, payload, refers_to, revisit):
                    made.append(one)
                    size += len(one)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])
                        made, size = [], 0
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])
        give_back()

    return run


def with_revisits(pages: DataFrame, least_revisit: int, scratch: Scratch, most_broadcast: int = 100_000) -> DataFrame:
    """page_id, url, payload, refers_to, revisit of each page.

    Digests and ids alone are shuffled to find equal payloads, combined before the shuffle whatever their
    number; the few groups of two rows or more meet the pages by broadcast behind a count, else by a join on the digest.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload_of(F.col("html")).alias("payload"))
    rows = rows.withColumn("same", F.when(F.octet_length("payload") >= least_revisit, F.unhex(F.sha2("payload", 256))))
    equal = rows.filter("same is not null").groupBy("same").agg(F.count("*").alias("n"), F.max("page_id").alias("largest"))
    groups = scratch.keep(equal.filter("n > 1").select("same", "largest"), "equal-pages")
    few = groups.count() <= most_broadcast
    met = rows.join(F.broadcast(groups) if few else groups, "same", "left")
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return met.select("page_id", "url", "payload", F.when(revisit, F.col("largest")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, path: str, segment_bytes: int = 16 << 10, chunk_bytes: int = 4 << 10, least_revisit: int = 1000, most_records: int = 2000, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archives of at most ``most_records`` records, so of a bounded size, gzipped as a whole, under ``path``."""
    if segment_bytes < 1 or chunk_bytes < 1:
        raise ValueError("segments and chunks hold at least one byte")
    small_batches(pages.sparkSession, most_rows=500)
    with Scratch(pages.sparkSession) as scratch:
        numbered = with_revisits(pages, least_revisit, scratch).select(F.monotonically_increasing_id().alias("number"), "page_id", "url", "payload", "refers_to", "revisit")
        made = numbered.mapInArrow(_records(segment_bytes, chunk_bytes, date), "value binary")
        made.select(F.col("value").cast("string")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", most_records).text(path)


def parse(archive: bytes) -> Iterator[dict]:
    """The records of an archive: named fields in lower case and the ``block``."""
    at = 0
    while at < len(archive):
        end = archive.find(b"\r\n\r\n", at)
        lines = archive[at:end].split(END)
        if end < 0 or not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in (line.partition(b":") for line in lines[1:])}
        start = end + 4
        if not fields.get("content-length", "").isdigit():
            raise ValueError(f"no length at byte {at}")
        at = start + int(fields["content-length"])
        if archive[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"the record's end is missing at byte {at}")
        yield fields | {"block": archive[start:at]}
        at += 4


def gunzipped(data: bytes) -> bytes:
    """All members of a gzip file, as archives may hold one for each record; other bytes as they are."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        if not member.eof:
            raise ValueError("a gzip member is cut off")
        data = member.unused_data
    return b"".join([*out, data])


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda v: int(v) if v is not None else None
    for batch in batches:
        for content in batch.column("content"):
            rows, size = [], 0
            for r in parse(gunzipped(content.as_py())):
                rows.append((r.get("warc-record-id"), r.get("warc-type"), r.get("warc-segment-origin-id"), number(r.get("warc-segment-number")), number(r.get("warc-segment-total-length")), number(r.get("warc-page-id")), r.get("warc-target-uri"), number(r.get("warc-refers-to-page-id")), r.get("warc-payload-digest"), r["block"]))
                size += len(r["block"])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RECORD_ARROW.types, strict=True)], schema=RECORD_ARROW)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RECORD_ARROW.types, strict=True)], schema=RECORD_ARROW)
    give_back()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives as it is stored, segments apart."""
    small_batches(spark, most_rows=500)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse_files, RECORD_SCHEMA)


def _message(block: bytes, kind: str, digest: str | None) -> tuple[int | None, str | None, bytes | None]:
    """(payload bytes, bare digest, payload) of an HTTP message; a revisit tells the first two by its headers."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        raise ValueError("the HTTP headers are cut off")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(END)[1:])}
    if kind == "revisit":
        known = base64.b32decode(digest.removeprefix("sha1:")).hex() if digest is not None and digest.startswith("sha1:") else None
        return int(fields[b"content-length"]) if b"content-length" in fields else None, known, None
    payload = unchunked(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
    if digest is not None and digest.startswith("sha1:") and digest != sha1_text(payload):
        raise ValueError("the payload's digest differs")
    return len(payload), hashlib.sha1(payload).hexdigest(), payload


def _joined(parts: list[dict]) -> bytes:
    """The block of parts that are in order, if they are whole."""
    if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
        raise ValueError(f"segments {[p['segment'] for p in parts]} are not whole")
    if parts[-1]["total"] is None:
        raise ValueError("the last segment is missing")
    block = b"".join(p["block"] for p in parts)
    if len(block) != parts[-1]["total"]:
        raise ValueError(f"segments hold {len(block)} bytes of {parts[-1]['total']}")
    return block


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of records that carry their ``parts`` (null: the record is whole)."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            parts, size, digest, payload, error = r["parts"], None, None, None, None
            try:
                size, digest, payload = _message(r["block"] if parts is None else _joined(parts), r["record_type"], r["digest"])
            except (ValueError, TypeError) as problem:  # a damaged page must not lose the others
                error = str(problem)
            rows.append((r["record_id"], r["page_id"], r["url"], r["record_type"], r["refers_to"], 1 if parts is None else len(parts), size, digest, payload, error))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PAGE_ARROW.types, strict=True)], schema=PAGE_ARROW)
    give_back()


def reassembled(records: DataFrame) -> DataFrame:
    """Pages from records; only parts are shuffled, each group being one page's."""
    part = "array<struct<segment int, total long, block binary>>"
    whole = records.filter("segment is null and record_type in ('response', 'revisit')")
    parts = records.filter("segment is not null").withColumn("origin", F.coalesce("origin_id", "record_id"))
    of_first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    grouped = parts.groupBy("origin").agg(
        *[of_first(c) for c in ("page_id", "url", "refers_to", "digest")],
        F.sort_array(F.collect_list(F.struct("segment", "total", "block"))).alias("parts"),
    )
    columns = ["record_id", "record_type", "page_id", "url", "refers_to", "digest", "block", "parts"]
    joined = grouped.select(F.col("origin").alias("record_id"), F.lit("response").alias("record_type"), "page_id", "url", "refers_to", "digest", F.lit(None).cast("binary").alias("block"), "parts")
    plain = whole.withColumn("parts", F.lit(None).cast(part)).select(*columns)
    return plain.mapInArrow(_decode, PAGE_SCHEMA).unionByName(joined.select(*columns).mapInArrow(_decode, PAGE_SCHEMA))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """record_id, page_id, url, record_type, refers_to, n_segments, payload_bytes, payload_digest, payload, error of each page."""
    return reassembled(read_records(spark, path))
