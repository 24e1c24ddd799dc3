"""WARC records in a content-addressed archive.

An archive is a folder of two Parquet tables. ``payloads`` holds the bytes of each payload once under
their SHA-256; that equal digests mean equal bytes is verified while the copies are merged. ``headers``
holds the exact head of every record, WARC and HTTP fields, and the digest of its payload. Records are
put together again by joining the two; ``export_warc`` writes them as WARC files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path
from .common import table

LEAST_BYTES = 1000  # shorter payloads are never revisited
DATE = "1970-01-01T00:00:00Z"  # pages carry no time
END = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ESCAPES = {"%": "%25", "\r": "%0D", "\n": "%0A"}  # in this order, undone in the other


def _escaped(text: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), ESCAPES.items(), text)


def _unescaped(text: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[1]), F.lit(pair[0])), reversed(ESCAPES.items()), text)


def _head(row: dict[str, Column], date: str) -> Column:
    """WARC fields, an empty line, HTTP fields, an empty line; fields without a value are left out."""
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    name_of = lambda key: F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat_ws(
        END,
        F.lit("HTTP/1.1 200 OK"),
        F.lit("Content-Type: text/html; charset=UTF-8"),
        field("Content-Length", row["bytes"].cast("string")),
        F.lit(END),
    )
    revisit = row["revisits"].isNotNull()
    size = F.octet_length(http) + F.when(revisit, 0).otherwise(row["bytes"])
    return F.concat_ws(
        END,
        F.lit("WARC/1.1"),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", name_of(row["page_id"])),
        field("WARC-Target-URI", _escaped(row["url"])),
        F.lit(f"WARC-Date: {date}"),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), row["sha1"])),
        F.when(revisit, f"WARC-Profile: {REVISIT_PROFILE}"),
        F.when(revisit, field("WARC-Refers-To", name_of(row["revisits"]))),
        F.when(revisit, field("WARC-Refers-To-Target-URI", _escaped(row["revisits_url"]))),
        F.lit("Content-Type: application/http; msgtype=response"),
        field("Content-Length", size.cast("string")),
        F.concat(F.lit(END), http),
    )


def write_archive(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str = DATE) -> None:
    """One record per row of ``pages`` (page_id, url, html), in the two tables below ``path``.

    The payload is the html in UTF-8; NULL is empty. Of the rows with equal payloads of at least
    ``least_bytes`` the one with the largest page_id is a response, the others revisit it; rows that
    share this id and payload are all responses. A row without a page_id revisits such a response too,
    and is a response where no row has an id. Record ids follow page_id, so repeated ids repeat.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        payload.alias("payload"), F.sha2(payload, 256).alias("digest"),
    )
    # The set compares whole payloads, first within each task: one copy per task is shuffled.
    copies = rows.groupBy("digest").agg(F.collect_set("payload").alias("found"), F.max(F.struct("page_id", "url")).alias("owner"))
    differ = F.raise_error(F.concat(F.lit("different payloads under SHA-256 "), F.col("digest")))
    stored = F.when(F.size("found") == 1, F.col("found")[0]).otherwise(differ)
    copies.select("digest", "owner", stored.alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")

    owners = spark.read.parquet(f"{path}/payloads").select("digest", "owner")
    slim = rows.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    joined = slim.join(owners, "digest")
    owner = F.col("owner.page_id")
    revisits = F.when((F.col("bytes") >= least_bytes) & ~owner.eqNullSafe(F.col("page_id")), owner)
    joined = joined.withColumn("revisits", revisits).withColumn("revisits_url", F.col("owner.url"))
    head = _head({c: F.col(c) for c in joined.columns}, date)
    joined.select(head.alias("head"), "digest").write.option("compression", "zstd").parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str, **taken: Column) -> DataFrame:
    """(head, *taken) of every record, head and payload joined by digest.

    ``taken`` says what to take of ``payload``, by default the payload itself. It is computed once for
    each stored payload, before the join, so that what is smaller than the payload moves alone.
    """
    taken = taken or {"payload": F.col("payload")}
    payloads = spark.read.parquet(f"{path}/payloads").select(F.lit(True).alias("there"), "digest", *(c.alias(n) for n, c in taken.items()))
    joined = spark.read.parquet(f"{path}/headers").join(payloads, "digest", "left")
    lost = F.raise_error(F.concat(F.lit("no payload under SHA-256 "), F.col("digest")))
    return joined.select(F.when(F.col("there"), F.col("head")).otherwise(lost.cast("string")).alias("head"), *taken)


def fields(head: Column) -> dict[str, Column]:
    """What the head of a record says: page_id, url, record_type, refers_to, sha1."""
    value = lambda pattern: F.nullif(F.regexp_extract(head, pattern, 1), F.lit(""))
    there = F.contains(head, F.lit(f"{END}WARC-Target-URI: "))
    return {
        "page_id": value(r"\r\nWARC-Record-ID: <urn:page:(-?\d+)>\r").cast("long"),
        "url": F.when(there, _unescaped(F.regexp_extract(head, r"\r\nWARC-Target-URI: ([^\r]*)\r", 1))),
        "record_type": value(r"\r\nWARC-Type: ([^\r]*)\r"),
        "refers_to": value(r"\r\nWARC-Refers-To: <urn:page:(-?\d+)>\r").cast("long"),
        "sha1": value(r"\r\nWARC-Payload-Digest: sha1:([^\r]*)\r"),
    }


def export_warc(spark: SparkSession, path: str, to: str, **options: str) -> None:
    """The records of the archive as WARC/1.1 files; revisits carry no payload. ``compression="gzip"`` packs them.

    A record is written as one "line" of text whose line separator is the two line ends behind a record.
    """
    records = read_archive(spark, path)
    block = F.when(fields(F.col("head"))["record_type"] == "response", F.col("payload")).otherwise("")
    records.select(F.concat("head", block).alias("value")).write.options(lineSep=END * 2, **options).text(to)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the archive of ``pages``, then read its records back and check them against their digests."""
    path = new_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    found = read_archive(
        spark, path, payload_bytes=F.octet_length("payload").cast("long"), payload_digest=F.sha1("payload")
    )
    said = fields(F.col("head"))
    wrong = F.raise_error(F.concat(F.lit("payload differs from "), said["sha1"])).cast("string")
    return found.select(
        said["page_id"].alias("page_id"), "payload_bytes",
        F.when(F.col("payload_digest") == said["sha1"], F.col("payload_digest")).otherwise(wrong).alias("payload_digest"),
        said["record_type"].alias("record_type"), said["refers_to"].alias("refers_to"),
    )
