"""Content-addressed web archive (operator 1).

An archive is two tables in a shared folder.  ``payloads`` holds every distinct payload
once, under its SHA-256; ``headers`` holds the exact header bytes of each record, with
that key.  The record with the largest id of those with equal payloads is the response,
the others are revisits that refer to it; payloads below ``least`` bytes are always
responses.  Reading verifies each stored payload against its key (and fails if it
doesn't hold), and joins headers and payloads into the original WARC/1.1 records.

When writing, the payload column moves in one shuffle only, after each task has left out the
copies that it holds itself; which record is the response is found on (digest, id) rows.  When
reading, each stored payload moves once, to the headers that name it.

Defined results: null payloads are empty; null ids are the least; rows with equal id and
payload are one record each, all of the same type, and store their payload once; an empty
table makes an empty archive; other columns don't matter; a payload, of whatever length, is
never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: its 160 bits are eight groups of 20, four digits each."""
    h = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), DIGITS, BASE32)


def write_archive(rows: DataFrame, folder: str, key: str, url: str, payload: str, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes an archive of one record for each row; date is the time of capture, in UTC."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = rows.select(F.col(key).alias("id"), F.col(url).alias("url"), body.alias("body"))
    narrow = rows.select("id", "url", F.sha2("body", 256).alias("sha256"), base32_sha1(F.col("body")).alias("sha1"), F.octet_length("body").cast("long").alias("size"))
    chosen = narrow.groupBy("sha256").agg(F.max("id").alias("chosen"))
    headers = narrow.join(chosen, "sha256")
    revisit = (F.col("size") >= least) & ~F.col("id").eqNullSafe(F.col("chosen"))
    urn = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    lines = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("chosen")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")),
    )
    headers.select("id", "sha256", lines.cast("binary").alias("header")).write.parquet(f"{folder}/headers")
    rows.select(F.sha2("body", 256).alias("key"), "body").dropDuplicates(["key"]).write.option("compression", "zstd").parquet(f"{folder}/payloads")


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (key, body); a body that doesn't have its key's digest fails the query."""
    found = spark.read.schema("key string, body binary").parquet(f"{folder}/payloads")
    return found.select("key", F.when(F.sha2("body", 256) == F.col("key"), F.col("body")).otherwise(F.raise_error(F.concat(F.lit("payload is damaged: "), "key")).cast("binary")).alias("body"))


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (record_id, record_type, url, payload_digest, refers_to, key, header), read from the header bytes."""
    found = spark.read.schema("id long, sha256 string, header binary").parquet(f"{folder}/headers").withColumn("text", F.col("header").cast("string"))

    def field(name: str) -> Column:
        got = F.regexp_extract("text", rf"\r\n{name}: ([^\r\n]*)", 1)
        return F.when(F.contains("text", F.lit(f"{CRLF}{name}: ")), got)

    return found.select(
        F.regexp_extract(field("WARC-Record-ID"), "^<urn:record:(.*)>$", 1).alias("record_id"), field("WARC-Type").alias("record_type"), field("WARC-Target-URI").alias("url"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"), F.regexp_extract(field("WARC-Refers-To"), "^<urn:record:(.*)>$", 1).alias("refers_to"),
        F.col("sha256").alias("key"), "header",
    )


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (record_id, record_type, payload_digest, refers_to, record, payload): the original records, and the payloads that they stand for; a payload that doesn't have its header's digest fails the query."""
    rows = read_headers(spark, folder).join(read_payloads(spark, folder), "key")
    block = F.when(F.col("record_type") == "response", F.col("body")).otherwise(F.lit(b""))
    end = F.lit((CRLF * 2).encode())
    sha1 = base32_sha1(F.col("body"))
    same = F.when(sha1 == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("header and payload differ: "), "key")))
    return rows.select("record_id", "record_type", same.alias("payload_digest"), "refers_to", F.concat("header", end, block, end).alias("record"), F.col("body").alias("payload"))


def read_summary(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """A row for each record, with size and SHA-1 of the payload that it stands for, and the size and SHA-256 of the record, from the records as read back."""
    number = lambda c: F.when(F.col(c) != "", F.col(c).cast("long"))
    return read_records(spark, folder).select(
        number("record_id").alias(key), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type",
        F.when(F.col("record_type") == "revisit", number("refers_to")).alias("refers_to"), F.octet_length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"),
    )
