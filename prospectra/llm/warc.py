"""WARC archives with revisit records (WARC 1.1, ISO 28500).

Pages are reduced to headers, which are shuffled by payload digest; of equal payloads
the smallest page_id is the response and the others become revisits of it. Records are
written by Spark's text writer, whose line separator is the CRLF CRLF that ends a
record, so the files are plain (gzip) WARC files and commit as any Spark output does.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch, stored

#: Payloads with fewer bytes are never revisits.
LEAST_BYTES = 100
#: Bytes of payload in one archive, on average, and at most.
FILE_BYTES, MOST_BYTES = 32 << 20, 512 << 20
#: Pages are written apart by size, up to so many bytes in each class.
CLASSES = (1 << 16, 1 << 22)
_URN = "urn:x-page:"
_NS = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, record_type string, url string, payload_digest string, payload_bytes long, refers_to long"


def headers(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_digest, payload_bytes) of each page."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        body.alias("html"),
        F.sha2(F.encode(body, "UTF-8"), 256).alias("payload_digest"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
    )


def resolve(rows: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``rows`` of headers() with refers_to, the page_id of the response, and its url as
    refers_url; null for a response. A digest's rows are pre-aggregated and cut off, so
    that a much-copied payload meets one row over a plain exchange, which can split."""
    firsts = cut(
        rows.filter(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n"))
        .filter("n > 1 and first is not null")
        .select("payload_digest", "first")
    )
    other = (F.col("payload_bytes") >= least_bytes) & (F.col("page_id") != F.col("first.page_id"))
    joined = rows.join(firsts, "payload_digest", "left")
    return joined.withColumns({"refers_to": F.when(other, F.col("first.page_id")), "refers_url": F.when(other, F.col("first.url"))}).drop("first")


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n"))


def _uri(value: Column) -> Column:
    """A header value must not break its line."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"[\r\n]+", " ")


def record(when: str) -> Column:
    """A WARC record without the CRLF CRLF that ends it, from the columns of resolve() and
    ``repeated``: true where the page_id alone would not make the record's id unique."""
    again = F.col("refers_to").isNotNull()
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    page = F.when(F.col("repeated"), F.concat(page, F.lit(":"), F.uuid())).otherwise(page)
    block = F.when(again, F.lit("")).otherwise(F.col("html"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", F.concat(F.lit(f"<{_URN}"), page, F.lit(">"))),
        _line("WARC-Date", when),
        _line("WARC-Target-URI", _uri(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(
            again,
            F.concat(
                _line("WARC-Profile", _NS),
                _line("WARC-Refers-To", F.concat(F.lit(f"<{_URN}"), F.col("refers_to").cast("string"), F.lit(">"))),
                _line("WARC-Refers-To-Target-URI", _uri(F.col("refers_url"))),
                _line("WARC-Refers-To-Date", when),
            ),
        ).otherwise(F.lit("")),
        _line("Content-Type", "text/html; charset=UTF-8"),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_archives(pages: DataFrame, path: str, when: str | None = None) -> None:
    """Deduplicated archives of ``pages`` with fresh headers, dated ``when`` or now.

    A null html is an empty payload. Rows with a null or repeated page_id get a random
    part in their record ids. As nothing can refer to a null page_id, such a record is
    never a revisit. Pages of very different sizes are written to different files, so
    that no file holds more than MOST_BYTES of them or one page.
    """
    when = when or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = headers(pages)
    # only headers meet by digest; what comes back is a row for each revisit and for each
    # repeated id, stored so that Spark broadcasts it only if it is small
    heads = rows.select("page_id", "url", "payload_digest", "payload_bytes")
    twice = heads.groupBy("page_id").agg(F.count("*").alias("n")).filter("n > 1 and page_id is not null").select("page_id", F.lit(True).alias("repeated"))
    found = resolve(heads).filter("refers_to is not null").select("page_id", "payload_digest", "refers_to", "refers_url").distinct()
    again = stored(found.select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), "refers_to", "refers_url"), "warc-revisits")
    marked = rows.join(again, (F.col("page_id") == F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left")
    marked = marked.join(stored(twice, "warc-repeated"), "page_id", "left")
    marked = marked.withColumn("repeated", F.coalesce("repeated", F.col("page_id").isNull()))
    size = F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0))
    kind = sum(((size > n).cast("int") for n in CLASSES), F.lit(0))
    classes = pages.groupBy(kind.alias("k")).agg(F.count("*"), F.sum(size.cast("long")), F.max(size)).collect()
    for k, n, total, most in classes or [(0, 0, 0, 0)]:
        per_file = max(1, min(FILE_BYTES * n // max(1, total), MOST_BYTES // max(1, most)))
        (
            marked.filter(kind == k).select(record(when).alias("value"))
            .write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
        )


def parse(stream: BinaryIO) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(fields, block) of each record of an archive, by Content-Length."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) != b"\r\n":
            name, colon, value = line.partition(b":")
            if not colon or not line.endswith(b"\r\n"):
                raise ValueError(f"no field in {line[:40]!r}")
            fields[name] = value.strip()
        size = int(fields[b"Content-Length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record {fields.get(b'WARC-Record-ID')!r} does not end where it says")
        yield fields, block


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    def number(urn: bytes | None) -> int | None:
        found = re.fullmatch(rb"<urn:x-page:(-?\d+)(?::[0-9a-f-]+)?>", urn or b"")
        return int(found[1]) if found else None

    schema = pa.schema(
        [("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64())]
    )
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for b in batches:
        for content in b.column(0):
            rows = []
            # one record at a time is held, beside the compressed file
            for fields, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer())), 1 << 20)):
                kind, told = fields[b"WARC-Type"].decode(), fields[b"WARC-Payload-Digest"].decode().removeprefix("sha256:")
                size = len(block) if kind == "response" else None
                if size is not None and hashlib.sha256(block).hexdigest() != told:
                    raise ValueError(f"payload digest differs in {fields[b'WARC-Record-ID']!r}")
                rows.append((number(fields[b"WARC-Record-ID"]), kind, fields[b"WARC-Target-URI"].decode(), told, size, number(fields.get(b"WARC-Refers-To"))))
                if len(rows) == 10_000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a record. Digests of responses are checked; payload_bytes is null for a
    revisit, whose payload lies in the record it refers to."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_read, RECORDS)


def follow_revisits(records: DataFrame) -> DataFrame:
    """Give each revisit the size and digest of the response it refers to. Revisits are
    joined to unique record ids that are cut off from their aggregate, so one much-visited
    response splits as a skewed join."""
    sizes = cut(
        records.filter("record_type = 'response' and page_id is not null")
        .groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
        .agg(F.min("payload_bytes").alias("payload_bytes"))
    )
    again = records.filter("record_type = 'revisit'").drop("payload_bytes").join(sizes, ["refers_to", "payload_digest"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return records.filter("record_type = 'response'").select(*columns).unionByName(again.select(*columns))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write deduplicated archives into the shared folder, read them, follow revisits.

    Empty tables give an empty result. Rows repeated with one page_id and one payload
    are responses each (a record does not revisit itself). A page of any length is one
    record, read by itself; other columns are ignored.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path)
    return follow_revisits(cut(read_archives(spark, path)))
