"""Content-addressed web archive: payloads once, record headers apart, joined on reading.

The archive is two tables. ``payloads`` has one row per digest of the payload bytes;
``headers`` has the exact header bytes of every record and the digest that it names. A
record's original bytes are header + payload (responses) or header alone (revisits,
whose payload is the one that their digest names). Reading checks each stored payload
against its digest again, once, and fails on a payload that is missing or altered.

A payload of at least ``min_revisit`` bytes gets one response, the record with the
smallest id; the others are revisits that refer to it. Smaller payloads are stored once
too, but each record is a response.

Skew: which record is first is a hash aggregation with map-side combine, and rows meet
it through ``attach``, which serves frequent digests without sending their rows to one
task. Payload bytes are shuffled once, to be stored in buckets of their digests; reading
joins the buckets as they lie, but for payloads of very many records, which are sent once
to each part of their records.

Edge cases: null html is an empty payload. A null id sorts after all others; among rows
of one id and payload one row is the first, so that a repeated row is a revisit of its
twin. Line breaks in an url are percent-encoded in the header. An empty table gives an
empty archive. Other columns are not read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from airtide.operators import lookup
from airtide.operators.lookup import attach
from airtide.plans.staging import new_folder, stage

MIN_REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_URI = "urn:page:"
NULL_ID = "null"


@dataclass(frozen=True)
class Archive:
    """``payloads(digest, payload)`` and ``headers(digest, header)``."""

    payloads: DataFrame
    headers: DataFrame


def write_archive(
    pages: DataFrame,
    *,
    id: str = "page_id",
    url: str = "url",
    html: str = "html",
    date: str = "1970-01-01T00:00:00Z",
    min_revisit: int = MIN_REVISIT_BYTES,
) -> Archive:
    """Write both tables below the shared folder; ``date`` is the capture time to record."""
    payload = F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8")
    pages = pages.select(
        F.col(f"`{id}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("url"),
        payload.alias("payload"),
    ).select(
        "*",
        F.sha2("payload", 256).alias("digest"),
        F.octet_length("payload").cast("long").alias("n_bytes"),
    )
    records = stage(
        pages.select("id", "url", "digest", "n_bytes", F.monotonically_increasing_id().alias("row")),
        "warc-records",
    )
    first = records.groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first"),
        F.count("*").alias("n"),
    )
    first = first.select("digest", "n", "first.*")
    first = first.select("digest", "n", F.col("id").alias("first_id"), F.col("row").alias("first_row"))
    marked = attach(
        records, first, {"digest": F.col("digest")}, row_id="row", weight="n"
    )
    revisits = (F.col("n_bytes") >= min_revisit) & (F.col("row") != F.col("first_row"))
    headers = marked.select(
        "digest",
        F.encode(_header(revisits, date), "UTF-8").alias("header"),
    )
    return Archive(_payload_table(pages), stage(headers, "warc-headers"))


def _payload_table(pages: DataFrame) -> DataFrame:
    """Each digest's bytes once, in buckets of digests.

    The aggregation combines within a partition before it shuffles: of a hot payload at
    most one copy per partition is sent. The buckets are those of that shuffle, so that a
    join on the digest moves no payload again.
    """
    spark = pages.sparkSession
    folder, name = new_folder(spark, "warc-payloads"), f"warc_payloads_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    payloads = pages.select("digest", "payload").dropDuplicates(["digest"])
    writer = payloads.write.bucketBy(buckets, "digest").sortBy("digest")
    writer.mode("overwrite").option("path", folder).saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files are outside of the warehouse
    return stored


def _header(revisits: Column, date: str) -> Column:
    """The WARC header and, for the HTTP message in it, the HTTP header."""
    uri = lambda c: F.concat(
        F.lit(f"<{ID_URI}"), F.coalesce(c.cast("string"), F.lit(NULL_ID)), F.lit(">")
    )
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("n_bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.octet_length(http) + F.when(revisits, 0).otherwise(F.col("n_bytes"))
    target = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisits, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        uri(F.col("id")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        target,
        F.lit("\r\nWARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.when(
            revisits,
            F.concat(
                F.lit("\r\nWARC-Refers-To: "), uri(F.col("first_id")), F.lit(f"\r\nWARC-Profile: {PROFILE}")
            ),
        ).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        block.cast("string"),
        F.lit("\r\n\r\n"),
        http,
    )


def _verified(payloads: DataFrame) -> DataFrame:
    """The payloads; a stored payload that does not have its digest fails the job."""
    intact = F.sha2("payload", 256) == F.col("digest")
    checked = F.when(intact, F.octet_length("payload").cast("long")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match its digest "), "digest")).cast("long")
    )
    return payloads.withColumn("payload_bytes", checked)


def read_records(archive: Archive, *, with_bytes: bool = True) -> DataFrame:
    """Every record: its header fields, its payload's verified size, its original bytes.

    ``record`` is the record as it stands in a WARC file: headers, then the payload (not
    for revisits), then two line breaks; ``payload`` is the payload for both kinds.
    Without ``with_bytes`` both are left out and no payload is joined, only its size.
    """
    text = F.decode("header", "UTF-8")
    field = lambda name: F.regexp_extract(
        "head", rf"\r\n{name}: ([^\r\n]*)\r\n", 1
    )
    page = lambda name: F.regexp_extract(
        "head", rf"\r\n{name}: <{ID_URI}(-?\d+)>", 1
    ).try_cast("long")
    headers = archive.headers.withColumn("head", text).select(
        "header",
        F.monotonically_increasing_id().alias("row"),
        page("WARC-Record-ID").alias("id"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Target-URI").alias("url"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", "").alias("digest"),
        page("WARC-Refers-To").alias("refers_to"),
    )
    stored = _verified(archive.payloads)
    if with_bytes:
        found = _with_payloads(headers, stored)
    else:
        sizes = stored.select("digest", "payload_bytes")
        found = attach(headers, sizes, {"digest": F.col("digest")}, row_id="row")
    found = found.withColumn(
        "payload_bytes",
        F.when(F.col("payload_bytes").isNotNull(), F.col("payload_bytes")).otherwise(
            F.raise_error(F.concat(F.lit("no payload for digest "), "digest")).cast("long")
        ),
    ).drop("row")
    if with_bytes:
        body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
        found = found.withColumn(
            "record", F.concat("header", body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))
        )
    return found


def _with_payloads(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Left join on the digest; no payload is broadcast, and no task gets all rows of one.

    The rows of a digest with ``HEAVY_ROWS`` records or more are dealt into as many parts
    as hold that many, and its payload is sent once to each.
    """
    heavy = (
        headers.groupBy("digest")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= lookup.HEAVY_ROWS)
        .select(
            F.col("digest").alias("_digest"),
            F.ceil(F.col("n") / lookup.HEAVY_ROWS).cast("long").alias("parts"),
        )
    )
    heavy = stage(heavy, "warc-heavy")  # of N records there are at most N / HEAVY_ROWS such
    known = F.col("digest") == F.col("_digest")
    light = headers.join(F.broadcast(heavy), known, "left_anti")
    light = light.join(payloads.hint("merge"), "digest", "left")
    dealt = headers.join(F.broadcast(heavy), known).withColumn(
        "part", F.pmod(F.xxhash64("row"), F.col("parts"))
    )
    copies = payloads.join(F.broadcast(heavy), known).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    )
    dealt = dealt.drop("_digest", "parts").join(
        copies.drop("_digest", "parts"), ["digest", "part"], "left"
    )
    return light.unionByName(dealt.drop("part"))


def archive_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return records_report(read_records(write_archive(pages)))


def records_report(records: DataFrame) -> DataFrame:
    """Sizes and digests of the rebuilt records' payloads.

    The job fails where the record's length is not the one that its header tells.
    """
    told = F.regexp_extract(F.decode("header", "UTF-8"), r"\r\nContent-Length: (\d+)\r\n\r\n", 1)
    end = F.length(F.substring_index(F.decode("header", "UTF-8"), "\r\n\r\n", 1)) + 4
    head = F.octet_length(F.encode(F.substring(F.decode("header", "UTF-8"), F.lit(1), end), "UTF-8"))
    whole = F.octet_length("record") == head + told.cast("long") + 4
    size = F.when(whole, F.octet_length("payload").cast("long")).otherwise(
        F.raise_error(F.concat(F.lit("record of another length than told: "), "digest")).cast("long")
    )
    return records.select(
        F.col("id").alias("page_id"),
        size.alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


ARCHIVE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END
         AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
