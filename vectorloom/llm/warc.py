"""WARC archives as tables of record chunks: written, and read back, without whole records."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from vectorloom.llm.common import arrow_stage, table
from vectorloom.session import materialize, scratch_path

# Fixed values of the format: what a record begins with, and what ends it.
VERSION = "WARC/1.1"
BEGIN, END = f"{VERSION}\r\n", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEGMENT_BYTES = 1 << 20  # payload bytes of one chunk at most
LEAST_REVISIT = 1000  # payloads of fewer bytes are stored again
DATE = "2024-01-01T00:00:00Z"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard's namespace of URLs
_OUTPUT = 4 << 20


def _label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, 'record:' + ':'.join(map(str, parts)))}>"


def segments(payload: bytes, size: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """Cut a payload into chunks of at most ``size`` bytes, never inside a character, and
    inside each text that looks like the beginning of a record, so that none is in a chunk."""
    marker = VERSION.encode()
    at = 0
    while True:
        end = min(at + size, len(payload))
        found = payload.find(marker, at, end + len(marker))
        if found >= 0:
            end = min(end, found + 5)
        while end < len(payload) and payload[end] & 0xC0 == 0x80:
            end -= 1
        yield payload[at:end]
        at = end
        if at >= len(payload):
            return


def _write_records(run_id: str, size: int, date: str):
    def record(fields: list[tuple[str, object]], block: bytes) -> str:
        head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
        return f"{BEGIN}{head}Content-Length: {len(block)}\r\n\r\n{block.decode()}"

    def of_page(row: int, page, url, html: bytes, refers) -> Iterator[str]:
        digest = hashlib.sha1(html)
        uri = None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")
        common = [("WARC-Date", date), ("WARC-Target-URI", uri), ("Page-ID", page), ("Page-Row", f"{run_id}-{row}")]
        if refers is not None:
            yield record(
                [
                    ("WARC-Type", "revisit"), ("WARC-Record-ID", _record_id("revisit", run_id, row)), *common,
                    ("WARC-Profile", REVISIT_PROFILE), ("WARC-Payload-Digest", _label(digest.digest())),
                    ("WARC-Refers-To", _record_id("response", refers, digest.hexdigest())), ("Refers-To-Page", refers),
                ],
                b"",
            )
            return
        origin = _record_id("response", page, digest.hexdigest())
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
        whole = len(html) <= size and VERSION.encode() not in html
        sofar = hashlib.sha1()
        for number, part in enumerate(segments(html, size), 1):
            sofar.update(part)
            first = number == 1
            fields: list[tuple[str, object]] = [
                ("WARC-Type", "response" if first else "continuation"),
                ("WARC-Record-ID", origin if first else _record_id("continuation", run_id, row, number)),
                *common,
            ]
            if first:
                fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", _label(digest.digest()))]
            if not whole:
                fields += [("WARC-Segment-Number", number), ("Payload-Digest-So-Far", _label(sofar.digest()))]
                fields += [] if first else [("WARC-Segment-Origin-ID", origin)]
                last = sofar.digest() == digest.digest() and number > 1
                fields += [("WARC-Segment-Total-Length", len(http) + len(html))] if last else []
            block = http + part if first else part
            fields.append(("WARC-Block-Digest", _label(hashlib.sha1(block).digest())))
            yield record(fields, block)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        held: list[str] = []
        size_held = 0
        for batch in batches:
            for page, url, html, refers in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3).to_pylist()
            ):
                for text in of_page(row, page, url, html.as_py() or b"", refers):
                    held.append(text)
                    size_held += len(text)
                    if size_held > _OUTPUT:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])
                        held, size_held = [], 0
                row += 1
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])

    return run


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    segment_bytes: int = SEGMENT_BYTES, date: str = DATE,
) -> None:
    """Write gzipped WARC 1.1 files below ``path`` with a record for every row of ``pages``.

    Payloads of at most ``segment_bytes`` are one record; longer ones are a record and its
    continuation records, one chunk in memory at a time, each with the digest of the payload
    up to its end. Of equal payloads of at least 1000 bytes the one of the largest id is
    stored, the others refer to it; repeated rows of that id are all stored, and payloads
    without any id as well. A null page is an empty payload, a null address is left out.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), html.alias("html"),
        F.unhex(F.sha1(html.cast("binary"))).alias("digest"),
    )
    stored = rows.filter(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(
        F.max("page").alias("stored"), F.count("*").alias("n")
    )
    stored = stored.filter("n > 1").select("digest", "stored")
    refers = F.when(~F.col("page").eqNullSafe(F.col("stored")), F.col("stored"))
    dealt = rows.join(stored, "digest", "left").select("page", "url", "html", refers.alias("refers"))
    records = arrow_stage(dealt, _write_records(uuid.uuid4().hex[:12], segment_bytes, date), "value string")
    records.write.option("lineSep", END).option("compression", "gzip").text(path)


# --- reading --------------------------------------------------------------------------

_CHUNK = "page long, row string, type string, refers long, label string, number int, digest string, bytes long, data binary"


def _read_records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records to rows: a whole payload as its digest and length, a chunk of one as itself."""
    names = ("page", "row", "type", "refers", "label", "number", "digest", "bytes", "data")
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary())
    for batch in batches:
        rows = []
        for value in batch.column(0).cast(pa.binary()):
            head, _, rest = value.as_py().partition(END.encode())
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
            if "Page-Row" not in fields:
                raise ValueError(f"record {fields.get('WARC-Record-ID')} was not written by write_archives")
            block = rest[: int(fields["Content-Length"])]
            if len(block) != int(fields["Content-Length"]):
                raise ValueError(f"record {fields['WARC-Record-ID']} is cut off")
            if "WARC-Block-Digest" in fields and fields["WARC-Block-Digest"] != _label(hashlib.sha1(block).digest()):
                raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
            kind = fields["WARC-Type"]
            part = block.partition(b"\r\n\r\n")[2] if kind == "response" else block
            page, refers = fields.get("Page-ID"), fields.get("Refers-To-Page")
            number = fields.get("WARC-Segment-Number")
            whole = kind == "response" and number is None
            if whole and fields["WARC-Payload-Digest"] != _label(hashlib.sha1(part).digest()):
                raise ValueError(f"record {fields['WARC-Record-ID']} does not match its payload's digest")
            rows.append((
                None if page is None else int(page), fields["Page-Row"], kind, None if refers is None else int(refers),
                fields.get("WARC-Payload-Digest"), None if number is None else int(number),
                hashlib.sha1(part).hexdigest() if whole else None, len(part) if whole else None, part if number else None,
            ))
        columns = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))


def _join_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order to one row per record; holds one digest state, never a payload."""
    row = page = label = None
    state, size, following = hashlib.sha1(), 0, 1

    def done() -> pa.RecordBatch:
        if label != _label(state.digest()):
            raise ValueError(f"record of row {row} does not match its digest")
        return pa.RecordBatch.from_arrays(
            [pa.array([page], pa.int64()), pa.array([label]), pa.array([state.hexdigest()]), pa.array([size], pa.int64())],
            names=["page", "label", "digest", "bytes"],
        )

    for batch in batches:
        for own, page_, label_, number, data in zip(*(batch.column(k) for k in range(5))):
            if own.as_py() != row:
                if row is not None:
                    yield done()
                row, page, label = own.as_py(), page_.as_py(), label_.as_py()
                state, size, following = hashlib.sha1(), 0, 1
            if number.as_py() != following:
                raise ValueError(f"record of row {row} lacks chunk {following}")
            state.update(data.as_buffer())
            size += len(data.as_buffer())
            following += 1
    if row is not None:
        yield done()


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The records below ``path``: one row per record or chunk, with ``data`` for chunks."""
    texts = spark.read.option("lineSep", BEGIN).text(path).filter("value <> ''")
    return arrow_stage(texts, _read_records, _CHUNK)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(page, payload_bytes, payload_digest, record_type, refers_to)`` per record.

    Lengths and digests are those of the bytes read, and are compared with the digests in
    the headers; a revisit has them from the record that it refers to. Only chunks of
    oversized payloads move, in the order of their number. An empty folder gives no rows. A record of
    another writer, and a revisit whose response is not among the archives, stop the job.
    """
    rows = materialize(read_chunks(spark, path), "records")
    chunks = rows.filter("number is not null").select("row", "page", "label", "number", "data")
    joined = arrow_stage(
        chunks.repartition("row").sortWithinPartitions("row", "number"), _join_chunks, "page long, label string, digest string, bytes long"
    )
    whole = rows.filter("type = 'response' and number is null").select("page", "label", "digest", "bytes")
    stored = materialize(whole.unionByName(joined), "payloads")
    again = rows.filter("type = 'revisit'").select("page", "refers", "label")
    base = stored.select(F.col("page").alias("refers"), "label", "digest", "bytes").distinct()
    lost = F.concat(F.lit("no response for the revisit of page "), F.coalesce(F.col("page").cast("string"), F.lit("null")))
    found = again.join(base, ["refers", "label"], "left").withColumn(
        "bytes", F.when(F.col("bytes").isNull(), F.raise_error(lost)).otherwise(F.col("bytes"))
    )
    return stored.select(
        "page", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"),
    ).unionByName(
        found.select(
            "page", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
            F.lit("revisit").alias("record_type"), F.col("refers").alias("refers_to"),
        )
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back from them."""
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).withColumnRenamed("page", "page_id")


OP10_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), best AS (SELECT digest, max(page_id) AS stored FROM p WHERE n >= 1000 GROUP BY digest)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN stored <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN stored <> p.page_id THEN stored END AS refers_to
FROM p LEFT JOIN best ON p.digest = best.digest
"""
