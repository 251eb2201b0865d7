r"""WARC archives: writing captures, and transaction assembly when reading.

A capture is three records: a request, a response (or a revisit of an equal payload) and metadata,
tied by WARC-Concurrent-To. Archives are plain concatenated records; the reader cuts them by
Content-Length. Assembly joins the records of a capture through those identifiers to one nested row.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import joined, scratch, written

DATE = "2024-01-01T00:00:00Z"
#: Bytes of payload that an archive holds on average; captures are dealt to archives by hashes.
FILE_BYTES = 32 << 20
#: Bytes of records, or one longer record, that the reader gives on at a time.
BATCH_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a binary column: 40 hex digits in groups of five give four letters each."""
    digest = F.upper(F.sha1(payload))
    parts = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _name(kind: str, of: str = "") -> Column:
    """A record id from the capture and the kind of record; ``of`` is a prefix of the capture's columns."""
    parts = [F.col(f"{of}{c}").cast("string") for c in ("row", "page_id", "digest")]
    h = F.md5(F.concat_ws("|", *parts, F.lit(kind)))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.concat(F.lit(f"{k}: "), v) for k, v in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.lit("WARC/1.1\r\n"), F.concat_ws("\r\n", *lines, length), F.lit("\r\n\r\n"), block)


def write(pages: DataFrame, path: str, least: int = 0, date: str = DATE, file_bytes: int = FILE_BYTES) -> None:
    """Write a capture for each row of ``page_id, url, html`` to ``path``.

    Of captures with equal payloads (UTF-8 of html, null is empty) of ``least`` bytes or more, that with the smallest page_id is a
    response and the others revisit it; others are responses. Null ids come last, and of repeated rows one is the response. Control characters and blanks of a url are percent-encoded;
    a null url has no target header. The tables have no time of capture: all records have ``date``. An archive holds about ``file_bytes`` of payloads and
    the excess of a larger one; it is one gzip stream, as text writers make it. An empty table gives an archive without records; other columns are not read.
    """
    with scratch(pages.sparkSession):
        _write(pages, path, least, date, file_bytes)


def _write(pages: DataFrame, path: str, least: int, date: str, file_bytes: int) -> None:
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), F.monotonically_increasing_id().alias("row"), base32_sha1(payload).alias("digest"))
    # Written, so that a row keeps its number; payloads move once more, by that number.
    rows = written(rows.withColumn("bytes", F.octet_length("html").cast("long")), "pages")
    rank = F.struct(F.coalesce("page_id", F.lit(2**63 - 1)).alias("o"), F.col("row"), F.col("page_id"), F.col("digest"))
    first = rows.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("c")).filter("c > 1")
    ids = rows.filter(F.col("bytes") >= least).select("row", "digest")
    later = written(joined(ids, written(first, "first"), ["digest"], "c").filter("first.row != row").select("row", "first"), "later")
    files = int((rows.agg(F.sum("bytes")).first()[0] or 0) // file_bytes) + 1
    rows = rows.repartition(files, "row").join(later, "row", "left")
    again = F.coalesce(F.col("first.row") != F.col("row"), F.lit(False))
    refers = _name("response", "first.")
    target = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    common = lambda kind, record: [("WARC-Type", kind), ("WARC-Record-ID", record), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", target)]
    own = _name("response")
    host, place = F.regexp_extract("url", r"://([^/?#]*)", 1), F.regexp_extract("url", r"://[^/?#]*([^#\s]*)", 1)
    request = _record([*common(F.lit("request"), _name("request")), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.coalesce(place, F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit("\r\n\r\n")))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    kind = F.when(again, "revisit").otherwise("response")
    response = _record([*common(kind, own), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Refers-To", F.when(again, refers)), ("WARC-Profile", F.when(again, PROFILE)), ("Content-Type", F.lit("application/http; msgtype=response"))], F.when(again, head).otherwise(F.concat(head, F.col("html"))))
    metadata = _record([*common(F.lit("metadata"), _name("metadata")), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")))
    end = "\r\n\r\n"
    out = rows.select(F.concat_ws(end, request, response, metadata).alias("value"))
    out.write.option("compression", "gzip").option("lineSep", end).text(path)


_RECORDS = "type string, record_id string, concurrent_to string, refers_to string, uri string, date string, digest string, head string, body binary"


def _read(archive: io.BufferedIOBase) -> Iterator[tuple]:
    """The records of an archive, one after the other."""
    while line := archive.readline():
        if not line.startswith(b"WARC/1."):
            continue
        lines = []
        while (line := archive.readline().rstrip(b"\r\n")) != b"":
            lines.append(line.decode("utf-8", "replace"))
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        body = archive.read(int(headers["content-length"]))
        head = ""
        if headers.get("content-type", "").startswith("application/http"):
            a, _, body = body.partition(b"\r\n\r\n")
            head = a.decode("utf-8", "replace")
        digest = (headers.get("warc-payload-digest") or "").removeprefix("sha1:") or None
        yield (*(headers.get(f"warc-{k}") for k in ("type", "record-id", "concurrent-to", "refers-to", "target-uri", "date")), digest, head, body)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _RECORDS.split(", ")]
    kinds = [*[pa.string()] * 8, pa.binary()]
    batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
    for batch in batches:
        for content in batch.column(0):
            out, size = [], 0
            for record in _read(gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer()))):
                out.append(record)
                size += len(record[-1])
                if size >= BATCH_BYTES or len(out) >= 1000:
                    yield batch_of(out)
                    out, size = [], 0
            if out:
                yield batch_of(out)


def records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the gzip-compressed archives in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path)
    return files.select("content").mapInArrow(_parse, _RECORDS)


def captures(found: DataFrame, bodies: bool = True) -> DataFrame:
    """One nested row for each response or revisit, with its request and metadata and, of a revisit, what it refers to.

    A response's ``bytes`` and ``digest`` are those of the payload that was read; a revisit has no payload, and its header's digest.
    A capture without request or metadata has null there; of several, one is taken. Records that belong to no response are left out. Without ``bodies`` there is
    no ``body``, and payloads are measured where they are read and not moved.
    """
    read = F.col("type") == "response"
    main = found.filter("type in ('response', 'revisit')").withColumn("bytes", F.octet_length("body").cast("long")).withColumn("digest", F.when(read, base32_sha1(F.col("body"))).otherwise(F.col("digest")))
    main = main if bodies else main.drop("body")
    text = F.decode("body", "utf-8")
    of = lambda kind, fields: F.min(F.when(F.col("type") == kind, F.struct("record_id", "date", "head", fields.alias("fields")))).alias(kind)
    parts = found.filter("type in ('request', 'metadata') and concurrent_to is not null").groupBy(F.col("concurrent_to").alias("record_id")).agg(of("request", F.lit(None).cast("string")), of("metadata", text))
    # Written once: archives are parsed for the parts and for the captures, not again for what revisits refer to.
    whole = written(main.join(parts, "record_id", "left"), "captures")
    linked = F.coalesce((F.col("type") == "revisit") & F.col("refers_to").isNotNull(), F.lit(False))
    revisits = whole.filter(linked)
    origin = whole.filter("type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.min(F.struct("record_id", "bytes", F.col("metadata.fields").alias("fields"))).alias("origin"))
    origin = written(revisits.groupBy("refers_to").agg(F.count("*").alias("c")).join(origin, "refers_to", "left"), "origins")
    # Only revisits are joined: responses refer to nothing and stay where they are.
    kind = origin.schema["origin"].dataType
    out = whole.filter(~linked).withColumn("origin", F.lit(None).cast(kind)).unionByName(joined(revisits, origin, ["refers_to"], "c").drop("c"))
    return out.select("record_id", "type", "uri", "date", "digest", "head", *["body"] * bodies, "bytes", "request", "metadata", "origin")


def page_id_of(fields: Column) -> Column:
    """The page_id that a metadata record names."""
    return F.regexp_extract(fields, "page_id: (-?[0-9]+)", 1).try_cast("long")
