"""Content-addressed WARC archive.

Two datasets in the shared folder: ``payloads`` (digest, payload) has every distinct payload once,
``headers`` has the exact header block of every record and the digest of its payload. Payloads are
bucketed by digest when they are written, so that the join on the digest that rebuilds the records
moves headers only; what is read back is checked: the digest is computed again
from the stored bytes and compared with the one in the header, as is the length. All that is known of a record, its page and the
record that it refers to included, is read from its header.

Defined results: a null payload counts as empty. A null URL leaves out WARC-Target-URI; control
characters and blanks in a URL are percent-encoded, so that no URL can break a header. Of rows
that repeat a page_id and a payload of ``min_bytes`` or more one is the response, the others are
revisits that refer to it. A null page_id is larger than any other. An empty table gives an empty
archive. A payload of any length is one value. Other columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlake.session import shared_folder, written

CRLF = "\r\n"


@dataclass
class Archive:
    """Paths of the two datasets, and the number of buckets by digest of the payloads."""

    headers: str
    payloads: str
    buckets: int


@contextmanager
def _table(spark: SparkSession) -> Iterator[str]:
    """A passing name for an external table: only so are bucketed files written and read. The files stay."""
    name = f"warc_{uuid.uuid4().hex}"
    try:
        yield name
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _record_id(page_id: Column, nth: Column) -> Column:
    """A stable urn:uuid from the page id and, for repeated rows, their number."""
    h = F.md5(F.concat_ws("/", F.lit("page"), F.coalesce(page_id.cast("string"), F.lit("null")), nth.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _header(date: str) -> Column:
    """The header block of a record, ended by an empty line."""
    url = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]", "%20")
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    revisit = F.col("record_type") == "revisit"
    some = lambda cond, c: F.when(cond, c).otherwise("")
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        field("WARC-Type", F.col("record_type")),
        field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("nth"))),
        F.coalesce(field("X-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        field("WARC-Date", F.lit(date)),
        F.coalesce(field("WARC-Target-URI", url), F.lit("")),
        some(revisit, field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        some(revisit, F.coalesce(field("WARC-Refers-To", _record_id(F.col("refers_to"), F.lit(1))), F.lit(""))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        field("Content-Type", F.lit("text/html; charset=utf-8")),
        field("Content-Length", F.when(revisit, 0).otherwise(F.col("n")).cast("string")),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, min_bytes: int = 100, date: str = "2001-01-01T00:00:00Z") -> Archive:
    """Archive ``pages`` (page_id, url, html); payloads below ``min_bytes`` are never revisited.

    Copies of a payload collapse on the map side before the payload is shuffled. Record types are
    decided on small rows without payload.
    """
    spark = pages.sparkSession
    archive = Archive(shared_folder(spark, "warc-headers"), shared_folder(spark, "warc-payloads"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    once = rows.groupBy("digest").agg(F.max("payload").alias("payload"))
    with _table(spark) as name:
        once.write.option("compression", "zstd").option("path", archive.payloads).bucketBy(archive.buckets, "digest").saveAsTable(name)

    small = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("n"))
    first = small.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    nth = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy(F.coalesce("url", F.lit(""))))
    small = small.withColumn("nth", nth).join(first.where("copies > 1").select(F.col("digest").alias("_d"), "first_id"), F.col("digest") == F.col("_d"), "left")
    revisit = F.col("_d").isNotNull() & ~(F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("nth") == 1))
    small = small.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first_id")))
    small.select("digest", "record_type", _header(date).alias("header")).write.option("compression", "zstd").parquet(archive.headers)
    return archive


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """``header, block``: every record as archived; a revisit's block is empty."""
    headers = spark.read.parquet(archive.headers)
    with _table(spark) as name:
        spark.sql(f"CREATE TABLE {name} (digest STRING, payload BINARY) USING parquet OPTIONS (path '{archive.payloads}') CLUSTERED BY (digest) INTO {archive.buckets} BUCKETS")
        payloads = spark.table(name)
        payloads.schema  # resolves the table while its name exists
    full = headers.where("record_type = 'response'").join(payloads, "digest").select("header", "payload")
    empty = headers.where("record_type = 'revisit'").select("header", F.lit("").cast("binary").alias("payload"))
    return full.unionByName(empty).withColumnRenamed("payload", "block")


def record_bytes(records: DataFrame) -> DataFrame:
    """``record``: the bytes of each WARC record, ready to be concatenated to a file."""
    return records.select(F.concat(F.col("header").cast("binary"), F.col("block"), F.lit(CRLF * 2).cast("binary")).alias("record"))


def parse_records(records: DataFrame, id_type: str = "long") -> DataFrame:
    """Fields read from the header text, and whether a response's block has that digest and length."""
    value = lambda name: F.regexp_extract("header", rf"(?md)^{name}: (.*?)\r$", 1)
    out = records.select(
        F.nullif(value("X-Page-ID"), F.lit("")).cast(id_type).alias("page_id"), value("WARC-Record-ID").alias("record_id"), F.nullif(value("WARC-Refers-To"), F.lit("")).alias("refers_to_id"),
        value("WARC-Type").alias("record_type"), F.regexp_extract("header", r"(?md)^WARC-Payload-Digest: sha256:([0-9a-f]{64})\r$", 1).alias("payload_digest"),
        value("Content-Length").cast("long").alias("length"),
        F.sha2("block", 256).alias("found"), F.octet_length("block").cast("long").alias("found_bytes"),
    )
    ok = (F.col("record_type") == "revisit") | (F.col("found") == F.col("payload_digest")) & (F.col("found_bytes") == F.col("length"))
    return out.withColumn("verified", ok)


def op2_warc(pages: DataFrame) -> DataFrame:
    """Archive the pages and report what is read back; ``verified`` says that the bytes agree.

    A revisit finds its response by the record that its header refers to, and is verified if digest and bytes of that one agree.
    """
    spark = pages.sparkSession
    got = written(parse_records(read_records(spark, write_archive(pages)), pages.schema["page_id"].dataType.simpleString()), "warc-parsed")
    response = got.where("record_type = 'response'")
    target = response.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("found_bytes").alias("payload_bytes"), F.col("payload_digest").alias("_d"), F.col("verified").alias("_ok"))
    wanted = got.where("record_type = 'revisit'").select("refers_to_id").distinct()
    target = target.join(wanted, "refers_to_id", "left_semi")
    revisit = got.where("record_type = 'revisit'").select("page_id", "payload_digest", "record_type", "refers_to_id").join(target, "refers_to_id", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"]
    out = response.select("page_id", F.col("found_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast(pages.schema["page_id"].dataType).alias("refers_to"), "verified")
    return out.unionByName(revisit.withColumn("verified", F.coalesce(F.col("_ok") & (F.col("_d") == F.col("payload_digest")), F.lit(False))).select(*columns))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS n, sha256(h) AS d, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> f THEN f END AS refers_to, true AS verified
FROM q
"""
