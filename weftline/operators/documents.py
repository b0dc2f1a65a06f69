"""The table of uploaded documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MAX_BYTES = 10 << 20
MAX_PAGE = 100


def validate_uploads(files: DataFrame, stored: DataFrame | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """files (seq, file_name, content binary) with file_size, file_hash and reason, null for accepted files.

    Markdown up to ``max_bytes`` and not empty; the first of a name, then of a hash, is accepted; stored documents come before.
    """
    hashed = files.withColumns({"file_size": F.octet_length("content").cast("bigint"), "file_hash": F.sha2("content", 256)})
    bad = F.when(~F.lower("file_name").rlike(r"\.(md|markdown)$"), "type").when(F.col("file_size") > max_bytes, "size").when(F.col("file_size") == 0, "empty")
    rows = hashed.withColumn("bad", bad)
    if stored is not None:
        names = stored.select("file_name").distinct().withColumn("__n", F.lit(True))
        hashes = stored.select("file_hash").distinct().withColumn("__h", F.lit(True))
        rows = rows.join(names, "file_name", "left").join(hashes, "file_hash", "left")
    else:
        rows = rows.withColumns({"__n": F.lit(None).cast("boolean"), "__h": F.lit(None).cast("boolean")})
    good = F.col("bad").isNull()
    by_name = F.row_number().over(W.partitionBy("file_name", good).orderBy("seq"))
    rows = rows.withColumn("__name", F.coalesce(F.col("__n"), F.lit(False)) | (by_name > 1))
    fresh = good & ~F.col("__name")
    by_hash = F.row_number().over(W.partitionBy("file_hash", fresh).orderBy("seq"))
    rows = rows.withColumn("__hash", F.coalesce(F.col("__h"), F.lit(False)) | (by_hash > 1))
    reason = F.coalesce(F.col("bad"), F.when(F.col("__name"), "name exists"), F.when(F.col("__hash"), "content exists"))
    return rows.withColumn("reason", reason).drop("bad", "__n", "__h", "__name", "__hash")


def delete(documents: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents without the ids (id), ids that were refused): an indexed document stays."""
    asked = ids.select("id").distinct()
    refused = documents.filter("is_in_rag_system").select("id").join(asked, "id", "left_semi")
    return documents.join(asked.join(refused, "id", "left_anti"), "id", "left_anti"), refused


def status_bucket(status: Column) -> Column:
    """Running first, then waiting, then failed, then the others (fixed order)."""
    return F.when(status == "Processing", 0).when(status == "Pending", 1).when(status == "Failed", 2).otherwise(3)


def page(documents: DataFrame, number: int, size: int, tasks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of the page, totals): waiting and running documents show their task's live state."""
    number, size = max(1, number), min(MAX_PAGE, size) if size >= 1 else 10
    ordered = documents.orderBy(status_bucket(F.col("rag_status")), F.desc("upload_time"), "id").offset((number - 1) * size).limit(size)
    if tasks is not None:
        live = tasks.select(F.col("document_id").alias("id"), F.col("status").alias("__s"), F.col("progress").alias("__p"))
        at = F.col("rag_status").isin("Pending", "Processing")
        ordered = ordered.join(live, "id", "left").withColumns({"rag_status": F.when(at, F.coalesce("__s", "rag_status")).otherwise(F.col("rag_status")), "rag_progress": F.when(at, F.coalesce("__p", "rag_progress")).otherwise(F.col("rag_progress"))}).drop("__s", "__p")
    totals = documents.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))
    return ordered, totals
