"""WARC archives: writing with segmented records, and reassembly when read back.

Writing: each page is a response record whose block is an HTTP message in chunked transfer coding. A block
above ``SEGMENT`` bytes is cut into a first record and continuation records with the origin's identifier, a
segment number and, on the last, the total length. Of equal payloads of at least ``MIN_REVISIT`` bytes the
one with the largest id is written in full; the others become revisit records that name it.

Reading: files are parsed record by record; records with a segment number are grouped by origin identifier
(a group is one page, so it is bounded by that page), ordered by number, checked to be complete and as long
as the total says, and the chunked framing is decoded.

The records go through Spark's text writer with CRLF CRLF as the line end, which is how a WARC record ends,
so archives can be written to any store that Spark can write to.

Defined results: a null payload is written as an empty one; a null id is written without an id and comes
back null, and never owns a payload unless all ids of the group are null; repeated rows are each written, and
those equal in id and payload to the owner are responses too; an empty table gives no records; a missing,
repeated or short segment raises an error; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspan.operators.keyfilter import key_filter, split
from quillspan.sources.scratch import fresh_path, materialize

MIN_REVISIT, SEGMENT, CHUNK = 1000, 16 << 10, 4 << 10
#: Records of one archive file; groups of equal payloads that are broadcast at most.
FILE_RECORDS, BROADCAST_GROUPS = 1500, 100_000
_CRLF = b"\r\n"
_END = b"\r\n\r\n"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """``body`` in chunked transfer coding, no chunk ending inside a character."""
    out = [b"%x\r\n%s\r\n" % (len(x), x) for x in _cut(body, size) if x]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The body of a chunked message; an error if the framing is broken."""
    out, at = [], 0
    while True:
        eol = data.index(_CRLF, at)
        n = int(data[at:eol].split(b";")[0], 16)
        at = eol + 2
        if n == 0:
            return b"".join(out)
        if data[at + n : at + n + 2] != _CRLF:
            raise ValueError("a chunk does not end where its size says")
        out.append(data[at : at + n])
        at += n + 2


def _cut(block: bytes, size: int) -> list[bytes]:
    """Pieces of at most ``size`` bytes, none inside a character (records travel as text)."""
    out, at = [], 0
    while len(block) - at > size:
        end = at + size
        while block[end] & 0xC0 == 0x80:
            end -= 1
        out.append(block[at:end])
        at = end
    return [*out, block[at:]]


def _record(head: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the CRLF CRLF at its end, which the writer adds."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block


def records(page_id: int | None, mark: int, payload: bytes, digest: str, owner: int | None, revisit: bool, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page. ``mark`` makes identifiers unique among repeated rows."""
    uri = f"<urn:page:{'none' if page_id is None else page_id}:{mark}>"
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", uri), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page_id is not None:
        head.append(("WARC-Page-ID", page_id))
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page-ID", owner)]
        yield _record(head, f"{http}Content-Length: {len(payload)}\r\n\r\n".encode())
        return
    block = f"{http}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload)
    parts = _cut(block, segment)
    if len(parts) == 1:
        yield _record(head, block)
        return
    yield _record([*head, ("WARC-Segment-Number", 1)], parts[0])
    for n, part in enumerate(parts[1:], 2):
        tail = [("WARC-Segment-Total-Length", len(block))] if n == len(parts) else []
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{uri[:-1]}:{n}>"), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", uri), ("WARC-Segment-Number", n), *tail], part)


def write(pages: DataFrame, path: str, page_id: str = "page_id", payload: str = "html", segment: int = SEGMENT, min_revisit: int = MIN_REVISIT) -> None:
    """Write a record (or its segments) for every row of ``pages`` under ``path``."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    slim = pages.select(F.col(page_id).cast("long").alias("page_id"), body.alias("body")).withColumns({"bytes": F.octet_length("body"), "digest": F.sha1("body")})
    groups = slim.where(F.col("bytes") >= min_revisit).groupBy("digest", "bytes").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = materialize(groups.withColumnsRenamed({"digest": "g_digest", "bytes": "g_bytes"}), "warc-groups")
    same = (F.col("digest") == F.col("g_digest")) & (F.col("bytes") == F.col("g_bytes"))
    if groups.count() <= BROADCAST_GROUPS:
        joined = slim.join(F.broadcast(groups), same, "left")
    else:  # only pages that may belong to a group are shuffled
        some, none = split(slim, key_filter(groups.select(F.col("g_digest").alias("digest"), F.col("g_bytes").alias("bytes")), "digest", "bytes"), "digest", "bytes")
        joined = some.join(groups, same, "left").unionByName(none, allowMissingColumns=True)
    revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    told = joined.select("page_id", F.monotonically_increasing_id().alias("mark"), "body", "digest", "owner", revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                out = list(records(row["page_id"], row["mark"], row["body"], row["digest"], row["owner"], row["revisit"], segment))
                yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in out], pa.string())], ["value"])

    text = told.mapInArrow(run, "value string")
    text.write.option("lineSep", _END.decode()).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(_END, at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        n = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) != n or data[end + 4 + n : end + 8 + n] != _END:
            raise ValueError(f"the record at byte {at} is cut off")
        yield head, block
        at = end + 8 + n


_RECORD = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: record_id (of a continuation: its origin's), page_id, record_type, digest,
    refers_to, segment (null: not segmented), total, block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                rows: list[dict] = []
                for h, block in parse(data.as_py()):
                    number = lambda k, h=h: int(h[k]) if k in h else None
                    rows.append({"record_id": h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"]), "page_id": number("WARC-Page-ID"), "record_type": h["WARC-Type"], "digest": h.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None, "refers_to": number("WARC-Refers-To-Page-ID"), "segment": number("WARC-Segment-Number"), "total": number("WARC-Segment-Total-Length"), "block": block})
                    if len(rows) == 200:
                        yield pa.RecordBatch.from_pylist(rows, _RECORD)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, _RECORD)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "record_id string, page_id long, record_type string, digest string, refers_to long, segment int, total long, block binary")


def reassemble(rows: DataFrame) -> DataFrame:
    """page_id, record_type, digest, refers_to, n_segments, payload_bytes, payload (null for a revisit) of whole records."""
    whole = rows.where("segment is null").select("page_id", "record_type", "digest", "refers_to", F.array(F.struct(F.lit(1).alias("segment"), "block")).alias("parts"), F.lit(None).cast("long").alias("total"))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    cut = rows.where("segment is not null").groupBy("record_id").agg(first("page_id"), first("record_type"), first("digest"), first("refers_to"), F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                piece = b.slice(at, 64)
                out = []
                for row in piece.select(["parts", "total", "record_type", "digest"]).to_pylist():
                    if [p["segment"] for p in row["parts"]] != list(range(1, len(row["parts"]) + 1)):
                        raise ValueError("segments are missing or repeated")
                    block = b"".join(p["block"] for p in row["parts"])
                    if (row["total"] is None) != (len(row["parts"]) == 1) or row["total"] not in (None, len(block)):
                        raise ValueError("the segments are not as long as their total says")
                    head, body = block.split(_END, 1)
                    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                    payload = None if row["record_type"] == "revisit" else unchunked(body)
                    if payload is not None and hashlib.sha1(payload).hexdigest() != row["digest"]:
                        raise ValueError("a payload differs from its digest")
                    out.append((len(row["parts"]), int(fields["Content-Length"]) if payload is None else len(payload), payload))
                n, size, body = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("page_id", "record_type", "digest", "refers_to")), pa.array(n, pa.int32()), pa.array(size, pa.int64()), pa.array(body, pa.binary())], ["page_id", "record_type", "digest", "refers_to", "n_segments", "payload_bytes", "payload"])

    return whole.unionByName(cut.drop("record_id")).mapInArrow(run, "page_id long, record_type string, digest string, refers_to long, n_segments int, payload_bytes long, payload binary")


def round_trip(pages: DataFrame, page_id: str = "page_id", payload: str = "html") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the archives written."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(pages, path, page_id, payload)
    whole = reassemble(read(spark, path))
    return whole.select("page_id", "payload_bytes", F.coalesce(F.sha1("payload"), F.col("digest")).alias("payload_digest"), "record_type", "refers_to")
