"""WARC archives: write captures, read them back, assemble transactions.

Each capture becomes three WARC/1.1 records: a request, a response (or a revisit
of an earlier capture with the same payload) and a metadata record. Request and
metadata name the response in ``WARC-Concurrent-To``. Spark's text writer writes
the archives: a row is one record without its closing two line ends, which are the
writer's separator. So archives land on any file system that Spark can reach.
Archives are read as whole files, so their bytes are bounded: pages are written in classes of
size, the first up to ``file_bytes`` / ``file_pages``, each next one eight times larger, and an archive
of a class holds as many captures as fit in ``file_bytes`` at that size, one at least.

``assemble`` brings the records of a capture together by the concurrent-to
identifiers with one grouping and emits one nested row per capture.

Defined results. A null payload counts as empty, a null URL as ``about:blank``;
line ends in a URL are percent-encoded. Of equal payloads of at least
``least_bytes`` bytes the smallest id is the response (null ids rank last); rows
repeated with the same id give one response, the others revisit it. An empty table
writes no record. Payloads may hold any text, also WARC records themselves: the
reader goes by Content-Length alone.
"""

from __future__ import annotations

import gzip
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, table

CRLF = "\r\n"
FILE_BYTES, FILE_PAGES, BROADCAST_ROWS, CLASS = 256 << 20, 1024, 100_000, 8
DIGITS32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, http_headers string, payload binary, fields map<string,string>"


def base32_sha1(binary):
    """Bare upper-case base32 of the SHA-1: 20 bits are four digits at a time."""
    hexa = F.sha1(binary)
    four = [F.lpad(F.conv(F.substring(hexa, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*four), DIGITS32, BASE32)


def _lines(*pairs):
    return F.concat_ws(CRLF, *[F.concat(F.lit(f"{k}: "), v) for k, v in pairs])


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES, file_pages: int = FILE_PAGES) -> None:
    """Write one transaction per row of ``pages`` to WARC files under ``path``.

    The payloads of a file have at most ``file_bytes`` bytes, or it holds one capture.
    """
    ws = Workspace(pages.sparkSession, "warc")
    uri = F.replace(F.replace(F.coalesce(F.col(url).cast("string"), F.lit("about:blank")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = ws.write(
        pages.select(F.col(key).alias("page"), uri.alias("uri"), body.alias("body")).select(
            "page", "uri", "body", base32_sha1(F.col("body").cast("binary")).alias("digest"), F.octet_length("body").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row")
        ),
        "rows",
    )
    order = F.struct(F.col("page").isNull().alias("last"), "page", "row")
    first = rows.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = ws.write(rows.filter(F.col("bytes") >= least_bytes).select("digest", "row").join(first, "digest").filter("first.row <> row").select("row", "first"), "later")
    few = later.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    known = rows.join(F.broadcast(later) if few else later, "row", "left")
    name = lambda page, row, kind: F.concat(F.lit("<urn:kinetrail:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(f":{kind}>"))
    me = lambda kind: name(F.col("page"), F.col("row"), kind)
    revisit = F.col("first").isNotNull()
    head = lambda kind, uid, *more: F.concat(F.lit(f"WARC/1.1{CRLF}"), _lines(("WARC-Type", kind), ("WARC-Record-ID", uid), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("uri")), *more))
    record = lambda header, kind, block: F.concat(header, F.lit(f"{CRLF}Content-Type: {kind}{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    response = me("response")
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    request = F.concat(F.lit("GET "), F.col("uri"), F.lit(f" HTTP/1.1{CRLF * 2}"))
    facts = F.concat(F.lit("page-id: "), F.coalesce(F.col("page").cast("string"), F.lit("")), F.lit(CRLF))
    full = record(head(F.lit("response"), response, digest), "application/http; msgtype=response", F.concat(http, F.col("body")))
    again = record(
        head(F.lit("revisit"), response, digest, ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", name(F.col("first.page"), F.col("first.row"), "response"))),
        "application/http; msgtype=response",
        http,
    )
    records = F.array(
        record(head(F.lit("request"), me("request"), ("WARC-Concurrent-To", response)), "application/http; msgtype=request", request),
        F.when(revisit, again).otherwise(full),
        record(head(F.lit("metadata"), me("metadata"), ("WARC-Concurrent-To", response)), "application/warc-fields", facts),
    )
    least = max(1, file_bytes // file_pages)
    level = F.greatest(F.lit(0), F.ceil(F.log(F.greatest(F.col("bytes"), F.lit(1)) / float(least)) / math.log(CLASS) - 1e-9)).cast("int")
    for c in sorted(r[0] for r in rows.select(level.alias("c")).distinct().collect()) or [0]:  # a few classes of size
        own = known.filter(level == c).select(F.explode(records).alias("value"))
        own.write.mode("append").option("lineSep", CRLF * 2).option("maxRecordsPerFile", 3 * max(1, file_bytes // (least * CLASS**c))).option("compression", "gzip").text(path)
    ws.drop("rows", "later")


def parse_warc(data: bytes):
    """The records of one archive, as dicts; a broken rest raises ValueError."""
    if data.startswith(b"\x1f\x8b"):
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in data[at:end].decode().split(CRLF)[1:] if ": " in x)
        size = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError(f"a record of {size} bytes is cut at byte {at}")
        http, payload, fields = None, None, None
        if head["Content-Type"].startswith("application/http"):
            first, _, payload = block.partition(b"\r\n\r\n")
            http = first.decode()
        else:
            fields = [tuple(x.split(": ", 1)) for x in block.decode().split(CRLF) if ": " in x]
        yield {
            "record_id": head["WARC-Record-ID"], "record_type": head["WARC-Type"], "concurrent_to": head.get("WARC-Concurrent-To"), "refers_to": head.get("WARC-Refers-To"),
            "target_uri": head.get("WARC-Target-URI"), "date": head.get("WARC-Date"), "payload_digest": head.get("WARC-Payload-Digest"), "http_headers": http, "payload": payload, "fields": fields,
        }
        at = end + 4 + size + 4


def _parse(batches):
    import pyarrow as pa

    text = ["record_id", "record_type", "concurrent_to", "refers_to", "target_uri", "date", "payload_digest", "http_headers"]
    schema = pa.schema([(k, pa.string()) for k in text] + [("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string()))])
    for b in batches:
        for i in range(b.num_rows):
            rows, size = [], 0
            for r in parse_warc(b.column(0)[i].as_py()):
                rows.append(r)
                size += len(r["payload"] or b"")
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_warc(spark, path: str) -> DataFrame:
    """One row per record of the archives under ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(_parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture, joined through concurrent-to identifiers.

    A response or revisit without partners keeps null structs; request and
    metadata records that name no known response have a null ``response``.
    """
    own = F.col("record_type").isin("response", "revisit")
    pick = lambda when, name, *cols: F.first(F.when(when, F.struct("record_id", *cols)), ignorenulls=True).alias(name)
    return (
        records.withColumn("capture_id", F.when(own, F.col("record_id")).otherwise(F.col("concurrent_to")))
        .groupBy("capture_id")
        .agg(
            pick(own, "response", "record_type", "refers_to", "target_uri", "date", "payload_digest", "http_headers", "payload"),
            pick(F.col("record_type") == "request", "request", "http_headers"),
            pick(F.col("record_type") == "metadata", "metadata", "fields"),
        )
    )


def op7_warc(spark, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), f"{ws.path}/archive")
    captures = assemble(read_warc(spark, f"{ws.path}/archive"))
    full = F.col("response.record_type") == "response"
    page = lambda x: F.when(x != "", x).cast("long")
    return ws.result(captures.select(
        page(F.col("metadata.fields")["page-id"]).alias("page_id"),
        F.when(full, F.octet_length("response.payload")).otherwise(F.regexp_extract("response.http_headers", r"Content-Length: ([0-9]+)", 1)).cast("long").alias("payload_bytes"),
        F.when(full, base32_sha1(F.col("response.payload"))).otherwise(F.substring_index("response.payload_digest", ":", -1)).alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        page(F.split_part(F.col("response.refers_to"), F.lit(":"), F.lit(3))).alias("refers_to"),
    ))


ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h,
                  min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)
SELECT page_id, payload_bytes,
       {" || ".join(f"translate(to_base(('0x' || substr(h, {5 * i + 1}, 5))::BIGINT, 32, 4), '{DIGITS32}', '{BASE32}')" for i in range(8))} AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p
"""
