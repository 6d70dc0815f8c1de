"""WARC archives: records with segmented, chunked payloads written and read back by Spark.

Writer: one record per row. Among equal payloads of at least ``REVISIT_BYTES`` bytes that with the
largest id becomes the response and the others revisit it; shorter payloads are always responses.
A response holds an HTTP message whose body is framed by chunked transfer coding. A message longer
than ``SEGMENT_BYTES`` is cut into segments: the first is the response record, the rest are
continuation records with origin id, segment number and, on the last, the total length. Files are
gzip streams written by Spark's text sink: the value is the raw record, the line separator the two
CRLF that end a WARC record.

Reader: a gzip stream is read by one task from start to end, split at the same separator; the bytes
are joined again and cut by Content-Length, so payloads may hold the separator. It holds one record
at a time. Continuation records are grouped by origin id, ordered by segment number, checked against
the total length, then the chunked framing is decoded. Revisits take the length of the response they
refer to.

Defined cases: a null payload is empty; a null id is written without one and comes back null;
of equal payloads with null ids only, all are responses; rows that repeat the largest id are all
responses; an empty table gives an archive without records; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from .common import slices, written

REVISIT_BYTES = 1000
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
#: Records in one archive file at most.
FILE_RECORDS = 20_000

END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_FIELDS = "kind string, record_id string, page_id string, uri string, digest string, refers_to string, origin string, segment int, total bigint, block binary"


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The body in chunked transfer framing."""
    parts = []
    for at in range(0, len(body), size):
        part = body[at : at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    """The body of chunked transfer framing; extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        line = framed.index(b"\r\n", at)
        size = int(framed[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        if framed[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("a chunk does not end where its length says")
        parts.append(framed[line + 2 : line + 2 + size])
        at = line + 4 + size


def payload_of(message: bytes) -> bytes:
    """The payload of an HTTP response message."""
    head, _, body = message.partition(END)
    fields = dict(x.split(b":", 1) for x in head.lower().split(b"\r\n")[1:])
    return dechunked(body) if fields.get(b"transfer-encoding", b"").strip() == b"chunked" else body


def _header(kind: str, fields: list[tuple[str, object]], length: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + END


def _one_line(text: str | None) -> str | None:
    """A header value: controls, spaces and percent signs escaped, so that it stays on its line and can be had back."""
    if text is None:
        return None
    return "".join(c if c.isprintable() and c not in "% " else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def records(record_id: str, page_id, uri, digest: str, refers_to, payload: bytes | None, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The raw records (without their closing CRLFs) of one row; a payload of None makes a revisit."""
    own = [("WARC-Record-ID", f"<{record_id}>"), ("WARC-Page-ID", page_id), ("WARC-Target-URI", _one_line(uri)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if payload is None:
        yield _header("revisit", [*own, ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", _PROFILE)], 0)
        return
    message = _HTTP + chunked(payload)
    cuts = range(0, len(message), segment_bytes)
    if len(cuts) == 1:
        yield _header("response", own, len(message)) + message
        return
    for number, at in enumerate(cuts, 1):
        part = message[at : at + segment_bytes]
        fields = own if number == 1 else [("WARC-Record-ID", f"<{record_id}:{number}>"), ("WARC-Segment-Origin-ID", f"<{record_id}>")]
        last = [("WARC-Segment-Total-Length", len(message))] if number == len(cuts) else []
        yield _header("response" if number == 1 else "continuation", [*fields, ("WARC-Segment-Number", number), *last], len(part)) + part


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes ``pages`` as WARC archives (gzip) into the folder ``path``."""
    payload = F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long_enough = F.octet_length("payload") >= REVISIT_BYTES
    shared = (
        rows.where(long_enough).groupBy("digest").agg(F.max("id").alias("newest"), F.count("*").alias("n"))
        .where("n > 1").select(F.col("digest").alias("of"), "newest")
    )
    # a row that can't be a revisit joins nothing: its key is its own, so that no task gets all of them
    key = F.when(long_enough, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.col("url"))))
    rows = rows.withColumn("of", key).join(shared, "of", "left")
    rows = rows.withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("newest")), F.col("newest")))
    rows = rows.select("id", "url", "digest", "refers_to", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, "payload"):
                out: list[bytes] = []
                for row in zip(*(part.column(c).to_pylist() for c in ("id", "url", "digest", "refers_to", "payload"))):
                    page_id, url, digest, refers_to, body = row
                    number += 1
                    out += records(f"urn:record:{prefix}-{number}", page_id, url, digest, refers_to, body, segment_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    raw = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    raw.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _parsed(header: bytes, block: bytes) -> dict:
    lines = header.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    bare = lambda k: fields[k].strip("<>") if k in fields else None
    total, refers = fields.get("warc-segment-total-length"), bare("warc-refers-to")
    return {
        "kind": fields["warc-type"], "record_id": bare("warc-record-id"), "page_id": fields.get("warc-page-id"),
        "uri": unquote(fields["warc-target-uri"]) if "warc-target-uri" in fields else None, "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "refers_to": refers.removeprefix("urn:page:") if refers else None, "origin": bare("warc-segment-origin-id"),
        "segment": int(fields["warc-segment-number"]) if "warc-segment-number" in fields else None, "total": int(total) if total else None, "block": block,
    }


def cut(pieces: Iterator[bytes]) -> Iterator[dict]:
    """Records of one stream, given what lies between its CRLF CRLF separators, in order."""
    held = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
            held.extend(END)
        return piece is not None

    while True:
        while not held.strip(b"\r\n"):
            held.clear()
            if not more():
                return
        start = len(held) - len(held.lstrip(b"\r\n"))
        at = held.find(END, start)
        header = bytes(held[start:at])
        length = next((int(x.split(b":")[1]) for x in header.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        if length is None:
            raise ValueError("a WARC record without Content-Length")
        at += len(END)
        while len(held) < at + length:  # the block may hold the separator itself
            if not more():
                raise ValueError("the archive ends inside a record")
        yield _parsed(header, bytes(held[at : at + length]))
        del held[: at + length]


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The raw records of the gzip archives below ``path`` (``RECORD_FIELDS``)."""
    text = spark.read.option("lineSep", END.decode()).text(path)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    names = [x.split()[0] for x in RECORD_FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for part in slices(batch, "piece"):
                    yield from zip(part.column("file").to_pylist(), part.column("piece").to_pylist())

        schema = pa.schema([(n, pa.int32() if n == "segment" else pa.int64() if n == "total" else pa.binary() if n == "block" else pa.string()) for n in names])
        for _, group in groupby(rows(), key=lambda r: r[0]):
            held, size = [], 0
            for record in cut(piece for _, piece in group):
                held.append(record)
                size += len(record["block"])
                if size > (4 << 20) or len(held) >= 2000:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)

    return lines.mapInArrow(run, RECORD_FIELDS)


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n in range(batch.num_rows):
            part = batch.slice(n, 1)
            numbers, blocks, total = (part.column(c)[0].as_py() for c in ("numbers", "blocks", "total"))
            message = b"".join(blocks)
            complete = numbers == list(range(1, len(numbers) + 1)) and total == len(message)
            body = payload_of(message) if complete else None
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in _KEPT), pa.array([body], pa.binary())], [*_KEPT, "payload"])


_KEPT = ["kind", "record_id", "page_id", "uri", "digest", "refers_to"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Whole records: kind, record_id, page_id (string), uri, digest, refers_to and payload.

    The payload is null for revisits and for records of which a segment is missing or whose total
    length is not the one stated. Of a record whose first segment is missing, kind and record_id are known.
    """
    raw = scan(spark, path)
    whole = raw.where("kind = 'response' AND segment IS NULL").select(
        *_KEPT, F.array(F.lit(1)).alias("numbers"), F.array("block").alias("blocks"), F.octet_length("block").cast("long").alias("total")
    )
    first = F.struct(*[c for c in _KEPT])
    segments = (
        raw.where("segment IS NOT NULL").withColumn("origin", F.coalesce("origin", "record_id"))
        .groupBy("origin")
        .agg(
            F.max(F.when(F.col("segment") == 1, first)).alias("first"), F.max("total").alias("total"),
            F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        )
        .withColumn("first", F.coalesce("first", F.struct(*[{"kind": F.lit("response"), "record_id": F.col("origin")}.get(c, F.lit(None).cast("string")).alias(c) for c in _KEPT])))
        .select("first.*", F.col("parts.segment").alias("numbers"), F.col("parts.block").alias("blocks"), "total")
    )
    columns = ", ".join(f"{c} string" for c in _KEPT) + ", payload binary"
    bodies = whole.unionByName(segments).mapInArrow(_payloads, columns)
    return bodies.unionByName(raw.where("kind = 'revisit'").select(*_KEPT, F.lit(None).cast("binary").alias("payload")))


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes the archives below ``spark.checkpoint.dir``, reads them back and describes every record:
    id, ``payload_bytes`` and ``payload_digest`` of the full payload, ``record_type``, ``refers_to``, ``url``."""
    spark = pages.sparkSession
    path = scratch_path(spark, f"llm/warc-{uuid.uuid4().hex}")
    write(pages, path, id_col, url_col, payload_col)
    kind = pages.schema[id_col].dataType
    back = read(spark, path).select(
        F.col("page_id").cast(kind).alias(id_col), F.col("refers_to").cast(kind).alias("refers_to"), F.col("kind").alias("record_type"),
        F.col("uri").alias("url"), F.when(F.col("kind") == "response", F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )
    back = written(back, "warc-records")
    origins = back.where("record_type = 'response'").groupBy(F.col(id_col).alias("origin"), F.col("payload_digest").alias("origin_digest")).agg(F.max("payload_bytes").alias("origin_bytes"))
    revisits = back.where("record_type = 'revisit'").join(
        origins, (F.col("refers_to") == F.col("origin")) & (F.col("payload_digest") == F.col("origin_digest")), "left"
    ).withColumn("payload_bytes", F.col("origin_bytes"))
    columns = [id_col, "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    return back.where("record_type = 'response'").select(*columns).unionByName(revisits.select(*columns))
