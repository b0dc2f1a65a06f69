"""Documents from files: uploads of any encoding, and folders with one document each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))


#: Lead bytes of the frequent characters of a double-byte encoding (fixed values of the standards).
FREQUENT = {"gb18030": (0xB0, 0xD7), "big5": (0xA4, 0xC6)}


def _guess(raw: bytes) -> str:
    """The encoding of bytes without a mark that are not UTF-8: UTF-16 by its zero bytes, Latin if no two high bytes meet, else GBK or
    Big5, whichever is valid and has more of its frequent characters; GBK if they tie.
    """
    b = np.frombuffer(raw, np.uint8)
    zero = b == 0
    if zero.mean() > 0.2:
        return "utf-16-le" if zero[1::2].sum() >= zero[::2].sum() else "utf-16-be"
    high = b >= 0x80
    if not (high[1:] & high[:-1]).any():
        return "cp1252"
    best = ("cp1252", -1.0)
    for name, (first, last) in FREQUENT.items():
        try:
            wide = [c for c in raw.decode(name) if ord(c) >= 0x80]
        except UnicodeDecodeError:
            continue
        leads = [c.encode(name)[0] for c in wide]
        share = sum(first <= x <= last for x in leads) / max(1, len(leads))
        best = max(best, (name, share), key=lambda x: x[1])
    return best[0]


def decode_bytes(raw: bytes) -> str:
    """Text of bytes: by byte order mark, else strict UTF-8, else as guessed from the bytes; what that cannot read is replaced."""
    for mark, name in MARKS:
        if raw.startswith(mark):
            return raw.decode(name, "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode(_guess(raw), "replace")


def decode_content(content: Column) -> Column:
    """UTF-8 without a mark is decoded in the JVM; only what is not goes to Python."""

    @F.pandas_udf("string")
    def other(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in values:
            yield v.map(decode_bytes, na_action="ignore")

    text = F.try_validate_utf8(content.cast("string"))
    return F.when(text.isNotNull() & ~F.substring(content, 1, 3).isin(F.unhex(F.lit("EFBBBF"))), text).otherwise(other(content))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, content binary, length, modified) of the files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"), "content", "length", F.col("modificationTime").alias("modified"))


def read_folders(spark: SparkSession, path: str, name: str = "SKILL.md") -> DataFrame:
    """(file_path, content): each sub-folder's file, named after the folder."""
    files = spark.read.text(f"{path}/*/{name}", wholetext=True)
    return files.select(F.concat(F.regexp_extract(F.input_file_name(), r"([^/]*)/[^/]*$", 1), F.lit(".md")).alias("file_path"), F.col("value").alias("content"))


def read_table(spark: SparkSession, path: str, schema: str, backup: str | None = None) -> DataFrame:
    """A stored JSON table; a missing folder is an empty table. Broken lines are dropped, after a copy of them to ``backup`` if named."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(conf).exists(p):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    rows = lines.select("value", F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("r"))
    if backup is not None:
        broken = rows.filter("r._broken IS NOT NULL").select("value")
        if not broken.isEmpty():
            broken.write.mode("append").text(backup)
    return rows.filter("r._broken IS NULL").select("r.*").drop("_broken")
