"""WARC archives: write captures, read them back, assemble transactions.

Each capture is three records: request, response (or revisit) and metadata; request and metadata point to
the response by ``WARC-Concurrent-To``. Archives are written by Spark's text writer with the record
separator as line separator, and read back file by file, so both ends work on any store that Spark can reach. A file
holds so many captures of one size class that it stays under some 64 MB, or a single larger one.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.llm.memory import small_batches, tidy_batches
from voxelweave.scratch import Scratch

CRLF = "\r\n"
#: Size classes of captures: payload bytes below which (None: any), captures a file.
CLASSES = ((32 << 10, 2048), (1 << 20, 64), (None, 1))
#: Bytes of records in a batch on its way back.
BATCH_BYTES = 4 << 20
#: Characters that may not stand in a header line's target; they are percent-encoded.
CONTROL = [chr(c) for c in (*range(0x21), 0x7F)]
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = (
    "type string, record_id string, concurrent_to string, refers_to_id string, target string, digest string, "
    "block_bytes bigint, payload_sha256 string, payload string, fields map<string,string>"
)


#: Rows up to which a side table is broadcast (about 64 bytes each); above, the join shuffles.
BROADCAST_ROWS = 200_000


def payload_table(pages: DataFrame, id_col: str, body_col: str, url_col: str) -> DataFrame:
    """``page_id, url, body, payload_bytes, payload_digest``; a null body is empty."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    return pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), body.alias("body"),
        F.octet_length(body).cast("bigint").alias("payload_bytes"), F.sha2(body, 256).alias("payload_digest"),
    )


def choose_responses(table: DataFrame, min_bytes: int, scratch: Scratch) -> DataFrame:
    """Add ``first_id`` (page that holds the payload, if it is shared), ``revisit`` and ``nonce``.

    Of equal payloads of at least ``min_bytes``, the smallest page id (null last) is the response. Only
    digests, sizes and ids meet in the aggregates, combined on the map side; payloads are not moved for it.
    ``nonce`` tells rows apart that repeat an id.
    """
    small = table.select("page_id", "payload_bytes", "payload_digest")
    best = F.min(F.struct(F.col("page_id").isNull().alias("z"), F.col("page_id").alias("i"))).alias("b")
    firsts = small.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(best, F.count("*").alias("c")).where("c > 1")
    firsts = scratch.keep(firsts.select(F.col("payload_digest").alias("d_"), F.col("b.i").alias("first_id"), F.lit(True).alias("shared")), "firsts")
    again = scratch.keep(small.groupBy("page_id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("page_id").alias("p_"), F.lit(True).alias("repeated")), "repeated")
    bounded = lambda side: F.broadcast(side) if side.count() <= BROADCAST_ROWS else side
    # a record id can only be named if its page id is unique; payload and page are named in any case
    named = firsts.join(bounded(again.withColumnRenamed("repeated", "vague")), F.col("first_id").eqNullSafe(F.col("p_")), "left").drop("p_")
    firsts = scratch.keep(named.select("d_", "first_id", "shared", F.coalesce("vague", F.lit(False)).alias("vague")), "named")
    joined = table.join(bounded(firsts), F.col("payload_digest") == F.col("d_"), "left").join(bounded(again), F.col("page_id").eqNullSafe(F.col("p_")), "left")
    other = F.coalesce(F.col("shared"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(*table.columns, "first_id", "vague", other.alias("revisit"), F.when(F.col("repeated"), F.monotonically_increasing_id()).otherwise(F.lit(0)).alias("nonce"))


def _urn(kind: str, page: Column, nonce: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page.cast("string"), F.lit("null")), nonce.cast("string")))
    parts = [h.substr(a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))).otherwise(F.lit("")) for k, v in headers]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF))
    return F.concat(F.lit("WARC/1.1" + CRLF), *lines, size, block)


def write_archives(table: DataFrame, path: str, date: str) -> None:
    """Write chosen captures (see ``choose_responses``) as gzip-compressed WARC files, a folder for each size class."""
    low, most = 0, table.agg(F.max("payload_bytes")).first()[0] or 0
    for i, (high, captures_per_file) in enumerate(CLASSES):
        if i and low > most:
            break
        size = F.when(F.col("revisit"), 0).otherwise(F.col("payload_bytes"))
        some = table.where((size >= low) & (F.lit(True) if high is None else size < high))
        _write_class(some, f"{path}/class={i}", date, captures_per_file)
        low = high


def _write_class(table: DataFrame, path: str, date: str, captures_per_file: int) -> None:
    rid, first = _urn("response", F.col("page_id"), F.col("nonce")), F.when(~F.col("vague"), _urn("response", F.col("first_id"), F.lit(0)))
    # a header must stay on its line, whatever the url holds
    url = F.coalesce(F.col("url"), F.lit(""))
    url = F.when(url.rlike(r"[\x00-\x20\x7f]"), reduce(lambda u, c: F.replace(u, F.lit(c), F.lit(f"%{ord(c):02X}")), CONTROL, url)).otherwise(url)
    when, digest = F.lit(date), F.concat(F.lit("sha256:"), F.col("payload_digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", _urn("request", F.col("page_id"), F.col("nonce"))), ("WARC-Date", when), ("WARC-Target-URI", url), ("WARC-Concurrent-To", rid), ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), url, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF)),
    )
    main = [("WARC-Record-ID", rid), ("WARC-Date", when), ("WARC-Target-URI", url), ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http;msgtype=response"))]
    response = _record([("WARC-Type", F.lit("response")), *main], F.concat(http, F.col("body")))
    revisit = _record([("WARC-Type", F.lit("revisit")), *main, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", first)], http)
    fields = F.concat(
        F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(f"{CRLF}payload-bytes: "), F.col("payload_bytes").cast("string"),
        F.when(F.col("revisit"), F.concat(F.lit(f"{CRLF}refers-to-page: "), F.coalesce(F.col("first_id").cast("string"), F.lit("")))).otherwise(F.lit("")), F.lit(CRLF),
    )
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _urn("metadata", F.col("page_id"), F.col("nonce"))), ("WARC-Date", when), ("WARC-Concurrent-To", rid), ("Content-Type", F.lit("application/warc-fields"))], fields)
    text = F.concat_ws(CRLF * 2, request, F.when(F.col("revisit"), revisit).otherwise(response), metadata)
    table.select(text.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", captures_per_file).text(path)


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of one archive (gzip or plain), in order, by their stated lengths."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split(CRLF)
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines)
        block = data[end + 4 : end + 4 + int(head["Content-Length"])]
        at = end + 4 + len(block) + 4
        kind = head["WARC-Type"]
        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
        fields = dict(x.split(": ", 1) for x in block.decode().split(CRLF) if ": " in x) if kind == "metadata" else None
        yield {
            "type": kind, "record_id": head["WARC-Record-ID"], "concurrent_to": head.get("WARC-Concurrent-To"), "refers_to_id": head.get("WARC-Refers-To"),
            "target": head.get("WARC-Target-URI"), "digest": head.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None, "block_bytes": len(block),
            "payload_sha256": hashlib.sha256(payload).hexdigest() if payload is not None else None, "payload": payload.decode() if payload is not None else None, "payload_bytes_read": len(payload) if payload is not None else None, "fields": fields,
        }


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path`` (columns: ``RECORDS``)."""
    kinds = [("payload_bytes_read", pa.int64())]
    names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload_bytes_read"]
    types = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), kinds[0][1]]

    @tidy_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for r in parse_records(content.as_py()):
                    if not with_payload:
                        r["payload"] = None
                    r["fields"] = list(r["fields"].items()) if r["fields"] is not None else None
                    rows.append([r[n] for n in names])
                    size += 1000 + len(r["payload"] or "")
                    if size >= BATCH_BYTES:
                        yield packed(rows)
                        rows, size = [], 0
                yield packed(rows)

    def packed(rows: list[list]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length bigint, content binary").load(path).select("content")
    return files.mapInArrow(run, RECORDS + ", payload_bytes_read bigint")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, response, request, metadata`` (structs; null where missing).

    Records join on the id that request and metadata name as concurrent; both outer joins keep orphans.
    """
    cols = [c for c in records.columns if c not in ("concurrent_to",)]
    part = lambda *kinds: records.where(F.col("type").isin(*kinds)).select((F.col("record_id") if kinds[0] == "response" else F.col("concurrent_to")).alias("capture_id"), F.struct(*cols).alias(kinds[0]))
    return part("response", "revisit").join(part("request"), "capture_id", "full").join(part("metadata"), "capture_id", "full")


def archive_pages(
    pages: DataFrame, id_col: str = "page_id", body_col: str = "html", url_col: str = "url", min_bytes: int = 100,
    date: str = "2024-01-01T00:00:00Z", with_payload: bool = True,
) -> DataFrame:
    """Write one capture per row, read the archives back and return the assembled transactions.

    A null body is an empty payload; payloads under ``min_bytes`` are never revisits; a null id sorts last;
    repeated rows are captures of their own, and alike (all responses, or all revisits); a null url is an empty target;
    other columns are ignored; an empty table gives an empty table.
    """
    spark = pages.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "warc")
    table = payload_table(pages, id_col, body_col, url_col)
    # written once: each size class reads it, and the numbers that tell repeated ids apart stay as they are
    chosen = scratch.keep(choose_responses(table, min_bytes, scratch), "chosen", codec="zstd")
    write_archives(chosen, scratch.path("archives"), date)
    return assemble(scratch.keep(read_archives(spark, scratch.path("archives"), with_payload), "records"))


def capture_digest(captures: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``, from the records as read.

    A response's digest is computed from the payload read; a revisit's comes from its header.
    """
    m, r = F.col("metadata.fields"), F.col("response")
    number = lambda k: F.nullif(F.element_at(m, F.lit(k)), F.lit("")).cast("bigint")
    return captures.select(
        number("page-id").alias("page_id"), F.coalesce(r["payload_bytes_read"], number("payload-bytes")).alias("payload_bytes"),
        F.coalesce(r["payload_sha256"], r["digest"]).alias("payload_digest"), r["type"].alias("record_type"), number("refers-to-page").alias("refers_to"),
    )
