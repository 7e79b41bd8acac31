"""WARC archives: writing with revisit and continuation records, and segment reassembly.

Writing: a page becomes one record, its payload in chunked transfer framing inside an HTTP
response. Blocks longer than ``SEGMENT_BYTES`` are cut: the first segment is the record itself,
the others are ``continuation`` records that name it as their origin; the last one carries the
total length. Of equal payloads only the one with the smallest page id is archived, the
others are ``revisit`` records without a body.

Reading: records are parsed by their stated lengths in the task that reads a file. A record
without continuations is decoded there. Segments are grouped by the origin's id, ordered by
number, checked to be gapless and of the stated total length, joined and decoded. Only
segments of cut records are shuffled with their bytes.

Archives go through Spark's own text writer (the last line feed of each record is the line
separator), so any file system Spark can write will do. Files hold at most
``RECORDS_PER_FILE`` pages.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from linkweave.llm.common import utf8_length
from linkweave.session import cut_lineage, fresh_path

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
RECORDS_PER_FILE = 2048
LEAST_REVISIT_BYTES = 100
_BATCH_BYTES = 8 << 20

# Fixed values of the formats.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_END = b"\r\n\r\n"

_PARSED = pa.schema([
    ("origin", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("warc_type", pa.string()),
    ("page_id", pa.int64()), ("refers_to", pa.int64()), ("stated_digest", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("error", pa.string()), ("block", pa.binary()),
])
_PARSED_SQL = (
    "origin string, segment bigint, total bigint, warc_type string, page_id bigint, refers_to bigint, "
    "stated_digest string, payload_bytes bigint, payload_digest string, error string, block binary"
)


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing; the empty payload is the last chunk alone."""
    parts = [payload[i:i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The payload of chunked framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        line = framed.index(b"\r\n", at)
        length = int(framed[at:line].split(b";")[0].strip(), 16)
        at = line + 2
        if length == 0:
            if framed[at:at + 2] != b"\r\n" and not framed.endswith(_END):
                raise ValueError("framing does not end")
            return b"".join(out)
        if framed[at + length:at + length + 2] != b"\r\n":
            raise ValueError("chunk of another length than stated")
        out.append(framed[at:at + length])
        at += length + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return b"%b\r\n%bContent-Length: %d\r\n\r\n%b%b" % (VERSION, lines.encode(), len(block), block, _END)


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"


def page_records(
    row_id: int, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
    segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES,
) -> bytes:
    """All records of a page, one after another."""
    name = hashlib.md5(f"{row_id}:{page_id}:{digest}".encode()).hexdigest()
    uuid = lambda h: f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"
    head = [("WARC-Record-ID", uuid(name)), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)),
            ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-ID", page_id)]
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    kind = ("Content-Type", "application/http;msgtype=response")
    if refers_to is not None:
        block = f"{http}Content-Length: {len(payload)}\r\n\r\n".encode()
        return _record([("WARC-Type", "revisit"), *head, ("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", refers_to), kind], block)
    block = f"{http}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload, chunk_bytes)
    parts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        return _record([("WARC-Type", "response"), *head, kind], block)
    out = [_record([("WARC-Type", "response"), *head, ("WARC-Segment-Number", 1), kind], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        own = hashlib.md5(f"{name}:{n}".encode()).hexdigest()
        total = len(block) if n == len(parts) else None
        out.append(_record([
            ("WARC-Type", "continuation"), ("WARC-Record-ID", uuid(own)), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)),
            ("WARC-Segment-Origin-ID", uuid(name)), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total),
        ], part))
    return b"".join(out)


def write_archives(
    pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, least_revisit: int = LEAST_REVISIT_BYTES,
    records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) below ``path``, gzipped.

    A null html is an empty payload, a null url ``about:blank``. Rows that share payload and
    smallest page id are all responses; rows without a page id come after all others, and
    are responses if no row of their payload has one.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest")
    )
    groups = rows.where(utf8_length("html") >= least_revisit).groupBy("digest")
    firsts = groups.agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_id"))
    firsts = cut_lineage(firsts.where("n > 1 and first_id is not null").select(F.col("digest").alias("of"), "first_id"), "firsts")
    rows = rows.join(firsts, F.col("digest") == F.col("of"), "left").select(
        F.monotonically_increasing_id().alias("row_id"), "page_id", "url", F.col("html").cast("binary").alias("html"), "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"),
    )

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, size = [], 0
            for row in zip(*batch.columns):
                made.append(page_records(*(v.as_py() for v in row), segment_bytes=segment_bytes)[:-1])
                size += len(made[-1])
                if size >= _BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])
                    made, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    lines = rows.mapInArrow(records, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).text(path)


def _unzipped(content: bytes) -> Iterator[bytes]:
    """Pieces of a gzip file of one or many members, or of a plain file."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view = memoryview(content)
    while view:
        inflate = zlib.decompressobj(31)
        rest: bytes | memoryview = view
        while not inflate.eof:
            piece = inflate.decompress(rest, 1 << 20)
            rest = inflate.unconsumed_tail
            if piece:
                yield piece
            elif not rest and not inflate.eof:
                raise ValueError("gzip file ends early")
        view = memoryview(inflate.unused_data)


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of an archive file."""
    pieces, held = _unzipped(content), b""

    def upto(n: int) -> bool:
        nonlocal held
        more = []
        have = len(held)
        while have < n:
            piece = next(pieces, None)
            if piece is None:
                break
            more.append(piece)
            have += len(piece)
        held = b"".join([held, *more]) if more else held
        return have >= n

    while True:
        while (end := held.find(_END)) < 0 and upto(len(held) + 1):
            pass
        if end < 0:
            if held.strip():
                raise ValueError("archive ends inside a header")
            return
        lines = held[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("record does not begin with a version line")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(headers["content-length"])
        if not upto(end + 4 + size + 4):
            raise ValueError("archive ends inside a block")
        block, held = held[end + 4:end + 4 + size], held[end + 8 + size:]
        yield headers, block


def decoded_payload(block: bytes) -> bytes:
    """Payload of an HTTP response block, out of its transfer framing."""
    head, _, body = block.partition(_END)
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _judged(block: bytes, digest: str | None) -> tuple[int | None, str | None, str | None]:
    try:
        payload = decoded_payload(block)
    except (ValueError, IndexError) as fault:
        return None, None, f"framing: {fault}"
    found = hashlib.sha256(payload).hexdigest()
    return len(payload), found, None if digest in (None, found) else "digest differs"


def _parsed_row(headers: dict[str, str], block: bytes) -> tuple:
    number = lambda name: int(headers[name]) if name in headers else None
    kind, digest = headers.get("warc-type"), headers.get("warc-payload-digest", "").removeprefix("sha256:") or None
    segment, origin = number("warc-segment-number"), headers.get("warc-segment-origin-id", headers.get("warc-record-id"))
    size, found, error, kept = None, None, None, None
    if segment is not None:
        kept = block
    elif kind == "revisit":
        stated = re.search(rb"(?im)^content-length: (\d+)\r?$", block)
        size, found = int(stated[1]) if stated else None, digest
    else:
        size, found, error = _judged(block, digest)
    return (origin, segment, number("warc-segment-total-length"), kind, number("x-page-id"), number("x-refers-to-page-id"),
            digest, size, found, error, kept)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per archived page: ``page_id, payload_bytes, payload_digest, record_type, refers_to, error``.

    ``error`` is null, or says what is wrong with the record: a missing or repeated segment, a
    total length that differs, broken framing, a digest that differs; sizes are then null.
    Record types other than response, revisit and continuation are passed over.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for headers, block in parse_records(content.as_py()):
                    if headers.get("warc-type") not in ("response", "revisit", "continuation"):
                        continue
                    rows.append(_parsed_row(headers, block))
                    size += 300 + len(rows[-1][-1] or b"")
                    if size >= _BATCH_BYTES:
                        yield _parsed_batch(rows)
                        rows, size = [], 0
                yield _parsed_batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parsed = files.select("content").mapInArrow(parse, _PARSED_SQL)
    first = lambda name: F.max(name).alias(name)  # only the origin's own record has these
    origin_type = F.max(F.when(F.col("warc_type") != "continuation", F.col("warc_type"))).alias("record_type")
    grouped = parsed.groupBy("origin").agg(
        origin_type, *map(first, ("page_id", "refers_to", "stated_digest", "payload_bytes", "payload_digest", "error", "total")),
        F.array_sort(F.collect_list(F.when(F.col("segment").isNotNull(), F.struct("segment", "block")))).alias("segments"),
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            sizes, digests, errors = (columns[n].to_pylist() for n in ("payload_bytes", "payload_digest", "error"))
            for i, segments in enumerate(columns["segments"]):
                if len(segments):
                    parts = segments.as_py()
                    stated, total = columns["stated_digest"][i].as_py(), columns["total"][i].as_py()
                    block = b"".join(p["block"] for p in parts)
                    if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or total is None:
                        errors[i] = "segments missing or repeated"
                    elif len(block) != total:
                        errors[i] = "total length differs"
                    else:
                        sizes[i], digests[i], errors[i] = _judged(block, stated)
            kept = [columns[n] for n in ("page_id", "record_type", "refers_to")]
            made = [pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*kept, *made], names=["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "error"]
            )

    out = "page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, error string"
    return grouped.drop("origin").mapInArrow(join, out).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"
    )


def _parsed_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in _PARSED]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _PARSED)], schema=_PARSED)


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write all ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, **options)
    return read_archives(spark, path)


WARC_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= {LEAST_REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to, NULL::VARCHAR AS error
FROM f
"""
