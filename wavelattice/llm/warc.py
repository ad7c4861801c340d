"""WARC archives: writing, reading, and reassembly of segmented records.

:func:`write_archives` writes one record per page to gzip-per-record archive
files in the shared folder, a payload with chunked transfer framing, long
records as segments (first segment plus ``continuation`` records), repeated
payloads as ``revisit``. A manifest (a stored table) lists the files of the
task attempts that succeeded; readers trust it alone, so files of lost
executors do no harm. :func:`read_records` streams the files record by record,
and :func:`reassemble` groups continuation records by origin identifier,
orders them by segment number, checks numbering and total length, and
:func:`decode_chunked` undoes the framing. Archives are read and inflated
once: what is whole is finished where it is read, and only segments move on.

Defined results: a null payload is an empty one; a null page_id is written
as such and comes back null; of repeated page_ids each row is a record of its
own; a record with a missing, repeated or short segment comes back with a
null block and the reason in ``error``; an empty table gives no records;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, open_input, open_output, shared_dir, shuffle_parts, stored, stored_map

_CRLF = b"\r\n"
RECORDS = "record_id string, record_type string, page_id long, refers_to long, payload_digest string, origin_id string, segment int, total_length long, block binary"


def encode_chunked(data: bytes, size: int = 8192) -> bytes:
    parts = []
    for at in range(0, len(data), size):
        part = data[at : at + size]
        parts += [b"%x\r\n" % len(part), part, _CRLF]
    return b"".join(parts) + b"0\r\n\r\n"


def decode_chunked(data: bytes) -> bytes:
    """The body inside chunked framing (extensions and trailers allowed); ValueError if it is cut short."""
    out, at = [], 0
    while True:
        end = data.find(_CRLF, at)
        if end < 0:
            raise ValueError("chunk size is missing")
        size = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if at + size + 2 > len(data):
            raise ValueError("chunk is cut short")
        out.append(data[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode() + _CRLF + block + _CRLF + _CRLF) + squeeze.flush()


_DATE = "1970-01-01T00:00:00Z"
#: Fixed value of the format: the profile of a revisit whose payload is the same.
_SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _one_line(url: str | None) -> str:
    return (url or "").replace("\r", "").replace("\n", "")


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_to_url: str | None, revisit: bool, segment_bytes: int, record_id: str) -> Iterator[bytes]:
    """The page's record, gzip-compressed; with its continuations when it is long."""
    base = [("WARC-Date", _DATE), ("WARC-Target-URI", _one_line(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-ID", "" if page_id is None else str(page_id))]
    if revisit:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(payload)
        refers = [("WARC-Profile", _SAME_PAYLOAD), ("WARC-Refers-To-Target-URI", _one_line(refers_to_url)), ("WARC-Refers-To-Date", _DATE), ("X-Refers-To-Page", str(refers_to))]
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), *refers, *base], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + encode_chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        yield _record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), *base], block)
        return
    for k, part in enumerate(parts, 1):
        own = [("WARC-Type", "response" if k == 1 else "continuation"), ("WARC-Record-ID", f"<urn:uuid:{record_id if k == 1 else uuid.uuid5(uuid.UUID(record_id), str(k))}>"), ("WARC-Segment-Number", str(k))]
        if k > 1:
            own.append(("WARC-Segment-Origin-ID", f"<urn:uuid:{record_id}>"))
        if k == len(parts):
            own.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record([*own, *(base if k == 1 else [])], part)


def write_archives(pages: DataFrame, file_bytes: int = 8 << 20, segment_bytes: int = 1 << 16) -> DataFrame:
    """``pages``: page_id, url, payload, digest, refers_to, refers_to_url, revisit. Returns the manifest (path, records)."""
    root = shared_dir(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, sink, size, n = None, None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if sink is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    sink, size, n = open_output(path), 0, 0
                for record in page_records(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], row["refers_to_url"], row["revisit"], segment_bytes, str(uuid.uuid4())):
                    sink.write(record)
                    size, n = size + len(record), n + 1
                if size >= file_bytes:
                    sink.close()
                    sink = None
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

    return stored_map(pages, run, "path string, records long")


def _members(source, step: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one after another."""
    rest, unzip, out = b"", None, []
    while True:
        data = rest or source.read(step)
        if not data:
            break
        unzip = unzip or zlib.decompressobj(31)
        out.append(unzip.decompress(data))
        rest = unzip.unused_data
        if unzip.eof:
            yield b"".join(out)
            unzip, out = None, []
    if out:
        raise ValueError("archive is cut short")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(headers.get("content-length", 0))
    if not lines[0].startswith("WARC/") or len(rest) < size:
        raise ValueError("record is broken")
    return headers, rest[:size]


def read_records(manifest: DataFrame) -> DataFrame:
    """Every record of the manifest's files, in the columns of ``RECORDS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("origin_id", pa.string()), ("segment", pa.int32()), ("total_length", pa.int64()), ("block", pa.binary())])
        number = lambda h, k: int(h[k]) if h.get(k) else None
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_input(path) as source:
                    rows, held = [], 0
                    for member in _members(source):
                        h, block = parse_record(member)
                        rows.append((h.get("warc-record-id"), h.get("warc-type"), number(h, "x-page-id"), number(h, "x-refers-to-page"), h.get("warc-payload-digest", "").rpartition(":")[2] or None, h.get("warc-segment-origin-id"), number(h, "warc-segment-number"), number(h, "warc-segment-total-length"), block))
                        held += len(block)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    parts = shuffle_parts(manifest.sparkSession)
    return arrow_map(manifest.select("path").repartition(parts, "path"), run, RECORDS)


def reassemble(records: DataFrame) -> DataFrame:
    """record_id, record_type, page_id, refers_to, payload_digest, block, error: whole records of segments.

    Segments of one origin meet in one row, whose size is that of the record
    itself. Records that aren't segmented are left out.
    """
    columns = ["record_type", "page_id", "refers_to", "payload_digest"]
    parts = records.filter("segment IS NOT NULL").withColumn("origin", F.coalesce("origin_id", "record_id"))
    groups = parts.groupBy("origin").agg(
        *(F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in columns),
        F.sort_array(F.collect_list("segment")).alias("numbers"),
        F.expr("listagg(block) WITHIN GROUP (ORDER BY segment)").alias("block"),
        F.max("total_length").alias("total_length"),
    )
    error = (
        F.when(F.col("numbers") != F.sequence(F.lit(1), F.size("numbers")), "segments are missing or repeated")
        .when(F.col("total_length").isNull(), "the last segment is missing")
        .when(F.coalesce(F.octet_length("block"), F.lit(0)) != F.col("total_length"), "total length differs")
    )
    rows = groups.withColumn("error", error)
    return rows.select(F.col("origin").alias("record_id"), *columns, F.when(F.col("error").isNull(), F.col("block")).alias("block"), "error")


_PAYLOAD = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, digest_ok boolean, error string"
_PAYLOAD_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
_PAYLOAD_NAMES = [x.split()[0] for x in _PAYLOAD.split(", ")]


def payload_of(row: dict) -> tuple:
    """The columns of ``_PAYLOAD`` for a whole record."""
    keys = (row["page_id"], row["record_type"], row["refers_to"])
    if row.get("error") is not None or row["block"] is None:
        return (*keys, None, row["payload_digest"], None, row.get("error") or "no block")
    head, _, body = row["block"].partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(_CRLF)[1:])}
    if row["record_type"] == "revisit":
        return (*keys, int(fields.get(b"content-length", b"0")), row["payload_digest"], None, None)
    try:
        if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
            body = decode_chunked(body)
    except ValueError as e:
        return (*keys, None, row["payload_digest"], None, str(e))
    digest = hashlib.sha256(body).hexdigest()
    return (*keys, len(body), digest, digest == row["payload_digest"], None)


def payloads(records: DataFrame) -> DataFrame:
    """``_PAYLOAD`` of whole records, as :func:`reassemble` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if rows := [payload_of(r) for r in batch.to_pylist()]:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), _PAYLOAD_KINDS)], _PAYLOAD_NAMES)

    return arrow_map(records.select("page_id", "record_type", "refers_to", "payload_digest", "block", "error"), run, _PAYLOAD)


def finish_whole(records: DataFrame) -> DataFrame:
    """Records in one pass, stored: those that are whole as ``_PAYLOAD`` (column ``done``), segments as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done_kind = pa.struct(list(zip(_PAYLOAD_NAMES, _PAYLOAD_KINDS)))
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = [s is None for s in batch.column("segment").to_pylist()]
            done = [dict(zip(_PAYLOAD_NAMES, payload_of(r))) if w else None for r, w in zip(batch.to_pylist(), whole)]
            block = batch.column("block")
            block = pc.if_else(pa.array(whole), pa.scalar(None, block.type), block)
            columns = [block if f.name == "block" else batch.column(f.name) for f in batch.schema]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(done, done_kind)], [*batch.schema.names, "done"])

    fields = ", ".join(f"{x.split()[0]}: {x.split()[1]}" for x in _PAYLOAD.split(", "))
    return stored_map(records, run, f"{RECORDS}, done struct<{fields}>")


def archive_pages(pages: DataFrame, least_bytes: int = 100, file_bytes: int = 8 << 20, segment_bytes: int = 1 << 16) -> DataFrame:
    """Write every page to archives and read them back: one row per page.

    Which record answers for equal payloads is settled over digests alone; the
    payload itself moves once, to meet its page's decision.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    keyed = rows.withColumn("digest", F.sha2("payload", 256))
    large = keyed.filter(F.octet_length("payload") >= least_bytes)
    firsts = large.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("x"), F.count("*").alias("copies")).filter("copies > 1")
    firsts = stored(firsts.select("digest", F.col("x.page_id").alias("first"), F.col("x.url").alias("refers_to_url")))  # a join of two plain shuffles: a page that many share is split there
    marked = keyed.join(firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    dealt = marked.withColumns({"revisit": revisit, "refers_to": F.when(revisit, F.col("first"))})
    manifest = write_archives(dealt.select("page_id", "url", "payload", "digest", "refers_to", "refers_to_url", "revisit"), file_bytes, segment_bytes)
    found = finish_whole(read_records(manifest))
    return found.filter("done IS NOT NULL").select("done.*").unionByName(payloads(reassemble(found)))
