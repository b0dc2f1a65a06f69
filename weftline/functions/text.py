"""Scalar text functions, all of them JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separator of packed lists (source ids, file paths, descriptions).
SEP = "<SEP>"
#: Stages of a task and their texts (fixed values).
STAGE_TEXTS = {
    "DocumentChunking": "Document Chunking",
    "ProcessingChunks": "Processing Chunks",
    "StoringTextChunks": "Storing Text Chunks",
    "StoringChunkVectors": "Storing Chunk Vectors",
    "MergingEntities": "Merging Entities",
    "MergingRelations": "Merging Relations",
    "UpdatingStorage": "Updating Storage",
    "StoringFullDocument": "Storing Full Document",
    "Persisting": "Persisting",
    "Completed": "Completed",
}


def blank(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, r"(?U)\s+", "") == "", F.lit(True))


def strip(c: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def sanitize_encoding(c: Column) -> Column:
    """Drop characters outside the basic plane and the two non-characters; a blank text becomes empty."""
    return F.when(blank(c), "").otherwise(F.regexp_replace(c, r"[\x{10000}-\x{10FFFF}\x{FFFE}\x{FFFF}]", ""))


def sanitize(c: Column, remove_quotes: bool = False) -> Column:
    """``sanitize_encoding``, runs of white space as one blank, optionally without quotes, trimmed."""
    out = F.regexp_replace(sanitize_encoding(c), r"(?U)\s+", " ")
    return F.trim(F.translate(out, "\"'", "") if remove_quotes else out)


def summary(c: Column, n: int = 100) -> Column:
    """The first n characters and three dots if there are more; blank is empty."""
    return F.when(blank(c), "").when(F.char_length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def file_name(path: Column) -> Column:
    """Name for a path or an http(s) url: the last segment, percent-decoded for urls; ``unknown`` where there is none."""
    is_url = F.lower(path).startswith("http://") | F.lower(path).startswith("https://")
    url_path = F.regexp_extract(path, r"(?i)^https?://[^/?#]*([^?#]*)", 1)
    last = F.regexp_extract(url_path, r"([^/]*)$", 1)
    decoded = F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(blank(path), "unknown").when(is_url, F.when(blank(decoded), "unknown").otherwise(decoded)).when(base == "", path).otherwise(base)


def upload_name(name: Column, when: Column, file_hash: Column) -> Column:
    """A safe name for an uploaded file: stem, time stamp and eight digits of the hash."""
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    safe = F.translate(F.replace(stem, F.lit(" "), F.lit("_")), "()", "")
    return F.concat(safe, F.lit("_"), F.date_format(when, "yyyyMMddHHmmss"), F.lit("_"), F.left(file_hash, F.lit(8)), ext)


def absolute_url(url: Column, base: str) -> Column:
    return F.when(F.lower(url).rlike("^https?://"), url).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(url, "^/+", "")))


def format_file_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB with at most two decimals."""
    number = lambda x: F.regexp_replace(F.regexp_replace(F.format_string("%.2f", F.round(x, 2)), r"0+$", ""), r"\.$", "")
    d = n.cast("double")
    return (
        F.when(n < 0, "0 B")
        .when(n < 1 << 10, F.concat(number(d), F.lit(" B")))
        .when(n < 1 << 20, F.concat(number(d / (1 << 10)), F.lit(" KB")))
        .when(n < 1 << 30, F.concat(number(d / (1 << 20)), F.lit(" MB")))
        .otherwise(F.concat(number(d / (1 << 30)), F.lit(" GB")))
    )


def stage_text(stage: Column) -> Column:
    texts = F.create_map(*(F.lit(x) for pair in STAGE_TEXTS.items() for x in pair))
    return F.when(stage.isNull() | (stage == ""), "").otherwise(F.coalesce(F.element_at(texts, stage), stage))


def status_text(status: Column, stage: Column) -> Column:
    """Text of a status; a running task shows its stage."""
    busy = (status == "Processing") & stage.isNotNull() & (stage != "")
    return F.when(status.isNull() | (status == ""), "Not Added").when(busy, stage_text(stage)).otherwise(status)


def unpack(c: Column) -> Column:
    """Parts of a packed list, without blank ones."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SEP), lambda x: x != "")


def pack(c: Column) -> Column:
    return F.array_join(c, SEP)
