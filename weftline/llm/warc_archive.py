"""Content-addressed WARC archive.

Two tables: ``payloads`` holds each distinct payload once, under its SHA-256; ``records`` holds the exact header of every
record and the address of its payload. Original records come back by a join on the address.

The address is verified twice. While writing, payloads are grouped by SHA-256, SHA-1 and length together, and an address
with two such groups stops the job (of payloads below ``min_revisit``, which are never shared, only while reading). While reading, both digests are taken again from the stored bytes.

Records with equal payloads of at least ``min_revisit`` bytes: the one with the largest page id is ``response``, the
others ``revisit`` it. Nulls and odd input: a null payload is an empty one; a null url leaves Target-URI empty, and CR or
LF in it are percent-encoded; a null page id is the smallest; repeated rows with one page id and payload are all
responses when that id is the largest; an empty table gives an empty archive; other columns are not archived.

The hot payload: only addresses and ids are grouped with it, pre-aggregated before the shuffle, and its bytes are
reduced to one copy per task before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Fixed value: the format's name for a record whose payload is that of another.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(date: str, version: str = "WARC/1.1") -> Column:
    one = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    uri = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    revisit = F.col("record_type") == "revisit"
    return F.concat(
        F.lit(version + CRLF),
        one("WARC-Type", F.col("record_type")),
        one("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))),
        one("WARC-Date", F.lit(date)),
        one("WARC-Target-URI", uri),
        one("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(one("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))), one("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(""),
        one("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, payload: str = "html", min_revisit: int = 1000, date: str = "1970-01-01T00:00:00Z") -> None:
    """pages (page_id, url, <payload> string) -> ``path``/payloads and ``path``/records. ``date``: when they were captured."""
    raw = pages.select("page_id", "url", F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload"))
    raw = raw.withColumns({"address": F.sha2("payload", 256), "sha1": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("bigint")})
    once = raw.groupBy("address", "sha1", "n_bytes").agg(F.first("payload").alias("payload"))
    once.select("address", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")
    owners = raw.filter(F.col("n_bytes") >= min_revisit).groupBy("address").agg(F.max("page_id").alias("owner"), F.max(F.struct("sha1", "n_bytes")).alias("hi"), F.min(F.struct("sha1", "n_bytes")).alias("lo"))
    clash = F.assert_true(F.col("hi") == F.col("lo"), F.concat(F.lit("two payloads under address "), F.col("address")))
    owners = owners.select("address", "owner", clash.alias("checked")).filter(F.col("checked").isNull()).drop("checked")
    records = raw.select("page_id", "url", "address", "sha1", "n_bytes")
    # Only payloads that can be shared meet their owners; the others need no join, whose keys would all be one.
    alone = records.filter(F.col("n_bytes") < min_revisit).withColumn("owner", F.lit(None).cast(raw.schema["page_id"].dataType))
    records = records.filter(F.col("n_bytes") >= min_revisit).join(owners, "address").select(*records.columns, "owner").unionByName(alone)
    revisits = F.coalesce(F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner")), F.lit(False))
    records = records.withColumns({"record_type": F.when(revisits, "revisit").otherwise("response"), "refers_to": F.when(revisits, F.col("owner"))})
    records.select("address", _header(date).alias("header")).write.option("compression", "zstd").parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: header and its fields, payload, payload_bytes, payload_digest, and ``record``, the original bytes."""
    stored = spark.read.schema("address string, payload binary").parquet(f"{path}/payloads")
    sound = F.assert_true(F.sha2("payload", 256) == F.col("address"), F.concat(F.lit("damaged payload "), F.col("address")))
    stored = stored.select("address", "payload", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), sound.alias("sound")).filter(F.col("sound").isNull()).drop("sound")
    records = spark.read.schema("address string, header string").parquet(f"{path}/records")
    line = lambda name: F.regexp_extract("header", f"(?md)^{name}: ([^\r\n]*)\r$", 1)
    page = lambda name: F.regexp_extract("header", f"(?md)^{name}: <urn:page:(-?[0-9]*)>\r$", 1)
    fields = {
        "page_id": F.when(page("WARC-Record-ID") != "", page("WARC-Record-ID")).cast("bigint"),
        "record_type": line("WARC-Type"),
        "refers_to": F.when(page("WARC-Refers-To") != "", page("WARC-Refers-To")).cast("bigint"),
        "url": line("WARC-Target-URI"),
        "header_digest": F.substring_index(line("WARC-Payload-Digest"), ":", -1),
    }
    joined = records.withColumns(fields).join(stored, "address")
    agrees = F.assert_true(F.col("header_digest") == F.col("payload_digest"), F.lit("a record's digest is not its payload's"))
    joined = joined.withColumn("agrees", agrees).filter(F.col("agrees").isNull()).drop("agrees", "header_digest")
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.withColumn("record", F.concat(F.encode("header", "UTF-8"), body, F.encode(F.lit(CRLF * 2), "UTF-8")))


def digest(archive: DataFrame) -> DataFrame:
    """Figures of each record; those of the original record are taken from its reconstructed bytes."""
    return archive.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.octet_length("record").cast("bigint").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"))
