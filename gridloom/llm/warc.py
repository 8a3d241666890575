"""WARC archives: written in segments, read back and reassembled.

Writing: pages with equal payloads become one ``response`` record (the smallest id) and ``revisit`` records that refer to
it.  A response's block is an HTTP answer in chunked transfer framing, cut into segments: the first is the response
record, the others ``continuation`` records that name it (WARC-Segment-Origin-ID) with their number, the last with the
total length.  Records are rows of Spark's text writer whose line separator is the record separator of the format, so
archives land wherever Spark can write, a file per task and ``FILE_RECORDS`` records at most.  A record holds one segment,
so a file holds at most ``FILE_RECORDS`` times ``SEGMENT_BYTES`` and headers, whatever the pages' sizes.

Reading: archives are read as binary files and parsed by Content-Length.  Records of one segment are decoded in place;
continuation records are grouped by the identifier of their origin, ordered by segment number, checked against the total
length and joined before the chunked framing is decoded.  Groups have a page's own size; a hot payload is one response
and many small revisits, and only ids and digests of pages go through the join that finds the first of each payload.

Defined cases: a null payload is empty; a page with a null id has records and a row of its own and is first of its payload
only where no page with an id has it; of rows that repeat an id each has its own records (the id is the page's, the row
number tells them apart); an empty table gives an empty result; a missing or
short segment raises; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, ship, spread_join, table_path

SEGMENT_BYTES = 16 * 1024
CHUNK_BYTES = 4096
FILE_RECORDS = 2000
SEPARATOR = "\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def frame(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unframe(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = end + 4 + size


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return head.encode() + b"\r\n" + block


def name_of(page: int | None, row: int) -> str:
    return f"<urn:page:{'none' if page is None else page}:{row}>"


def records_of(page: int | None, row: int, url: str, payload: bytes, first: tuple[int | None, int], segment_bytes: int) -> list[bytes]:
    """The records of one page; ``first``: page and row of the payload's response."""
    own = [("WARC-Record-ID", name_of(page, row)), ("WARC-Date", _DATE), ("WARC-Target-URI", re.sub(r"[\x00-\x20]", "%20", url)),
           ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http;msgtype=response")]
    if (page, row) != first:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        return [record([("WARC-Type", "revisit"), *own, ("WARC-Refers-To", name_of(*first)),
                        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], block)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + frame(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        return [record([("WARC-Type", "response"), *own], block)]
    out = [record([("WARC-Type", "response"), *own, ("WARC-Segment-Number", "1")], parts[0])]
    for i, part in enumerate(parts[1:], 2):
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name_of(page, row)[:-1]}:{i}>"), ("WARC-Date", _DATE),
                  ("WARC-Segment-Origin-ID", name_of(page, row)), ("WARC-Segment-Number", str(i))]
        if i == len(parts):
            fields.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(record(fields, part))
    return out


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of every record of an archive."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield fields, block
        at = end + 8 + size


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write a record (or its segments) per page.  Payloads under ``min_bytes`` are never revisits."""
    ship(pages.sparkSession)
    read = pages.select(
        F.col(id_col).cast("long").alias("page"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    )
    read = materialise(read.withColumn("row", F.monotonically_increasing_id()), "pages")
    keys = read.select("page", "row", F.sha2("html", 256).alias("key"), F.octet_length("html").alias("size"))
    first = keys.groupBy("key").agg(F.min(F.struct(F.col("page").isNull().alias("none"), "page", "row")).alias("f"))
    small = F.col("size") < min_bytes
    named = spread_join(keys, first, ["key"]).select(
        "row", F.when(small, F.col("page")).otherwise(F.col("f.page")).alias("first_page"),
        F.when(small, F.col("row")).otherwise(F.col("f.row")).alias("first_row"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, row, url, html, p, r in zip(*batch.columns, strict=True):
                out += records_of(page.as_py(), row.as_py(), url.as_py(), html.as_py().encode("utf-8", "surrogatepass"),
                                  (p.as_py(), r.as_py()), segment_bytes)
                if len(out) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    rows = read.join(named, "row").select("page", "row", "url", "html", "first_page", "first_row")
    records = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    # the writer ends each row with the separator: a record's own end
    records.write.option("lineSep", SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


_FIELDS = "origin string, number int, total long, kind string, refers_to string, digest string, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives under ``path``."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        schema = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("kind", pa.string()),
                            ("refers_to", pa.string()), ("digest", pa.string()), ("block", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                data, rows = content.as_py(), []
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                for f, block in parse(data):
                    kind = f["warc-type"]
                    total = f.get("warc-segment-total-length")
                    rows.append((f["warc-segment-origin-id"] if kind == "continuation" else f["warc-record-id"],
                                 int(f.get("warc-segment-number", 0)), int(total) if total else None, kind,
                                 f.get("warc-refers-to"), f.get("warc-payload-digest", "").removeprefix("sha1:"), block))
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, _FIELDS)


def payloads(records: DataFrame) -> DataFrame:
    """origin, kind, refers_to, digest, size, payload of each page, its segments joined and its framing decoded."""
    part = F.struct("number", "block")
    whole = records.where("number = 0").select("origin", "kind", "refers_to", "digest", "total", F.array(part).alias("parts"))
    parts = records.where("number > 0").groupBy("origin").agg(
        F.max(F.when(F.col("kind") != "continuation", F.col("kind"))).alias("kind"), F.lit(None).cast("string").alias("refers_to"),
        F.max("digest").alias("digest"), F.max("total").alias("total"), F.sort_array(F.collect_list(part)).alias("parts"),
    )

    def joined(origin: str, total: int | None, segments: list[dict]) -> bytes:
        block = b"".join(x["block"] for x in segments)
        if segments[0]["number"] == 0:
            return block
        if [x["number"] for x in segments] != list(range(1, len(segments) + 1)) or len(block) != total:
            raise ValueError(f"segments missing of {origin}")
        return block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, sizes, digests = [], [], []
            for origin, kind, stated, total, segments in zip(*(batch.column(k) for k in (0, 1, 3, 4, 5)), strict=True):
                head, _, body = joined(origin.as_py(), total.as_py(), segments.as_py()).partition(b"\r\n\r\n")
                if b"transfer-encoding: chunked" in head.lower():
                    body = unframe(body)
                if kind.as_py() == "revisit":
                    sizes.append(int(re.search(rb"(?i)content-length: *([0-9]+)", head)[1]))
                    digests.append(stated.as_py())
                    bodies.append(None)
                else:
                    sizes.append(len(body))
                    digests.append(digest(body))
                    if digests[-1] != stated.as_py():
                        raise ValueError("a payload differs from its digest")
                    bodies.append(body)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(bodies, pa.binary())],
                names=["origin", "kind", "refers_to", "digest", "size", "payload"],
            )

    return whole.unionByName(parts).mapInArrow(run, "origin string, kind string, refers_to string, digest string, size long, payload binary")


def warc_round_trip(pages: DataFrame, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write the pages as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = table_path(spark, "warc")
    write_archives(pages, path, min_bytes=min_bytes, segment_bytes=segment_bytes)
    page = r"<urn:page:(-?[0-9]+):"
    return payloads(read_records(spark, path)).select(
        F.regexp_extract("origin", page, 1).try_cast("long").alias("page_id"), F.col("size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"),
        F.when(F.col("refers_to").isNotNull(), F.regexp_extract("refers_to", page, 1)).try_cast("long").alias("refers_to"),
    )
