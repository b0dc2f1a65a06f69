"""Parsing a model's answers into facts, and the memo of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sanitize, strip

MAX_ENTITIES, MAX_RELATIONS = 45, 60
END = "<|COMPLETE|>"
FIELD = r"<\|#\|>"


def _lines(responses: DataFrame, keys: list[str]) -> DataFrame:
    """Lines before the end mark, as arrays of fields, with their place."""
    lines = F.filter(F.split("response", "\n"), lambda x: x != "")
    end = F.array_position(F.transform(lines, lambda x: strip(x)), F.lit(END))
    kept = F.when(end > 0, F.slice(lines, F.lit(1), (end - 1).cast("int"))).otherwise(lines)
    return responses.select(*keys, F.posexplode(kept).alias("at", "line")).select(*keys, "at", F.split("line", FIELD, -1).alias("f"))


def _number(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    from pyspark.sql import Window as W

    return rows.withColumn("ord", F.row_number().over(W.partitionBy(*keys).orderBy("at")) - 1).filter(F.col("ord") < most).drop("at", "f")


def parse_entities(responses: DataFrame, keys: list[str], most: int = MAX_ENTITIES) -> DataFrame:
    """keys, ord, name, type, description of the entity lines."""
    f = lambda i: F.get("f", F.lit(i))
    rows = _lines(responses, keys).filter((F.size("f") >= 4) & (strip(f(0)) == "entity"))
    rows = rows.withColumns({"name": sanitize(f(1), True), "type": F.lower(F.replace(sanitize(f(2), True), F.lit(" "), F.lit(""))), "description": sanitize(f(3))})
    return _number(rows, keys, most)


def parse_relations(responses: DataFrame, keys: list[str], most: int = MAX_RELATIONS) -> DataFrame:
    """keys, ord, source_id, target_id, keywords, description, weight (1 unless the sixth field is a number)."""
    f = lambda i: F.get("f", F.lit(i))
    rows = _lines(responses, keys).filter((F.size("f") >= 5) & (strip(f(0)) == "relation"))
    number = F.regexp_replace(F.regexp_replace(strip(f(5)), r'^"+|"+$', ""), r"^'+|'+$", "")
    rows = rows.withColumns({"source_id": sanitize(f(1), True), "target_id": sanitize(f(2), True), "keywords": sanitize(f(3), True), "description": sanitize(f(4)), "weight": F.coalesce(number.try_cast("float"), F.lit(1.0).cast("float"))})
    return _number(rows, keys, most)


def parse_keywords(response: Column) -> Column:
    """Struct of two arrays from a JSON answer, fenced or not; both empty if either is missing or the JSON is bad."""
    bare = F.regexp_replace(strip(response), r"^```(?:json)?\s*|\s*```$", "")
    parsed = F.from_json(bare, "high_level_keywords array<string>, low_level_keywords array<string>")
    ok = parsed["high_level_keywords"].isNotNull() & parsed["low_level_keywords"].isNotNull()
    none = F.array().cast("array<string>")
    words = lambda k: F.when(ok, F.filter(parsed[k], lambda x: F.length(F.trim(x)) > 0)).otherwise(none)
    return F.struct(words("high_level_keywords").alias("high"), words("low_level_keywords").alias("low"))


def probe_cache(chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): cached answers under the chunk's present id and path, and chunks that a model still has to read."""
    hits = chunks.select("chunk_id", "file_path").join(cache, "chunk_id")
    return hits, chunks.join(cache.select("chunk_id"), "chunk_id", "left_anti")
