"""WARC archives with revisit records.

Headers (id, bytes, payload digest) are shuffled by digest to find the first page of each payload that occurs again. The
verdict, one row for each such digest, goes to the scan that writes; payloads stay where they are read. Every other page of
the digest becomes a revisit record without payload. Archives are written by Spark as text files whose line end is
CRLF, one gzip member a file, and read back file by file, each of bounded size.
"""

from __future__ import annotations

import gzip
import io
import itertools
import re
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, materialize, scratch, text_or_empty

DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
#: Fixed values of the format: the base32 alphabet and the profile of a revisit by payload digest.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records and bytes of a file: no file has more bytes, but for one of a single larger record.
FILE_RECORDS, FILE_BYTES = 4096, 1 << 29


def payload_digest(sha: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 in hex: five hex digits are 20 bits, which are four base32 digits."""
    parts = [F.lpad(F.conv(F.substring(sha, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def headers(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes and sha (SHA-1 in binary) of each page, as a table: payloads are left out."""
    payload = text_or_empty("html")
    rows = pages.select("page_id", F.octet_length(payload).cast("long").alias("payload_bytes"), F.unhex(F.sha1(payload.cast("binary"))).alias("sha"))
    return materialize(rows, "headers")


def resolve_revisits(pages: DataFrame, least_bytes: int = 0, known: DataFrame | None = None) -> DataFrame:
    """pages with payload, payload_bytes, payload_digest, record_type and refers_to; known: the headers, where made before.

    Of pages with equal payloads of at least least_bytes bytes the one with the smallest page_id is the response and
    the others revisit it; smaller payloads are all responses. Null html counts as empty. A null page_id comes after
    all others; rows that repeat the response's page_id and payload are responses too. No rows give no rows.
    """
    known = headers(pages) if known is None else known
    # equal digests are many rows of one key: counted before the shuffle
    firsts = known.filter(F.col("payload_bytes") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    firsts = materialize(firsts.filter("n > 1").select("sha", "first_id"), "firsts")
    rows = pages.select("page_id", "url", text_or_empty("html").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "sha": F.unhex(F.sha1(F.col("payload").cast("binary")))})
    again = (F.col("payload_bytes") >= least_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(few(firsts), "sha", "left").select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        payload_digest(F.hex("sha")).alias("payload_digest"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"),
    )


def record_text(date: str = DATE) -> Column:
    """The record of a resolved page, without its last line end."""
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
        field("Content-Length", F.col("payload_bytes").cast("string")),
        F.lit(CRLF),
    )
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20\x7F]", "%20")
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        field("WARC-Type", F.col("record_type")),
        field("WARC-Record-ID", urn("page_id")),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", url),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(field("WARC-Refers-To", urn("refers_to")), field("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
        F.lit(CRLF),
    )


def write_archives(resolved: DataFrame, path: str, date: str = DATE, per_file: int = FILE_RECORDS) -> None:
    """Writes one record per row under path, in gzip files of at most per_file records."""
    (
        resolved.select(record_text(date).alias("value"))
        .write.option("lineSep", CRLF)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", per_file)
        .text(path)
    )


def parse_archive(stream: BinaryIO) -> Iterator[tuple]:
    """The records of an archive: type, id, refers_to, digest, payload length, payload (None: revisit).

    Reads one record at a time, so that memory holds the largest record and not the file.
    """
    while line := stream.readline():
        head = [line]
        while (line := stream.readline()) not in (b"\r\n", b""):
            head.append(line)
        fields = dict(x.decode("utf-8", "replace").rstrip("\r\n").split(": ", 1) for x in head[1:])
        block = stream.read(int(fields["Content-Length"]))
        stream.read(4)
        http, _, payload = block.partition(b"\r\n\r\n")
        of_payload = int(re.search(rb"Content-Length: (\d+)", http)[1])
        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and len(payload) != of_payload:
            raise ValueError(f"record {fields['WARC-Record-ID']}: {len(payload)} bytes of payload, not {of_payload}")
        yield kind, fields["WARC-Record-ID"], fields.get("WARC-Refers-To"), digest, of_payload, payload if kind == "response" else None


READ_SCHEMA = "record_type string, record_id string, refers_id string, payload_digest string, payload_bytes long, payload binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under path: READ_SCHEMA; payload is null for revisits, or if not asked for."""

    columns = [c.split()[0] for c in READ_SCHEMA.split(", ")]

    def parse(batches):
        for batch in batches:
            for data in batch["content"]:
                records = parse_archive(gzip.open(io.BytesIO(data)))
                if not payloads:
                    records = ((*r[:5], None) for r in records)
                while rows := list(itertools.islice(records, 256)):
                    yield pd.DataFrame(rows, columns=columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(parse, READ_SCHEMA)


def archive_pages(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes pages as archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    One row per row of pages, repeated ones too; see resolve_revisits for nulls and ties. Pages of any length are written
    whole; a file holds fewer records where the longest is long. Records of null page_ids share the id `<urn:page:>` and
    come back with a null page_id. White space in urls becomes %20. No rows give no rows.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    known = headers(pages)
    longest = known.agg(F.max("payload_bytes")).first()[0] or 0
    per_file = max(1, min(FILE_RECORDS, FILE_BYTES // (longest + 4096)))
    write_archives(resolve_revisits(pages, least_bytes, known), path, per_file=per_file)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(.*)>$', 1) AS bigint)")
    return read_archives(spark, path, payloads=False).select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_id").alias("refers_to"),
    )
