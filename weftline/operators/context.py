"""Context for a prompt: fenced sections of entities, relations, chunks and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_name

#: Section titles (fixed values).
TITLES = (
    "Knowledge Graph Data (Entity)",
    "Knowledge Graph Data (Relationship)",
    "Document Chunks (Each entry shows the file name in brackets, refer to the `Reference Document List` for file paths)",
    "Reference Document List (Each entry shows the file name and file path. Use the file name in citations, not reference_id)",
)


def entity_line() -> Column:
    return F.concat(F.col("entity_id"), F.lit(" ("), F.coalesce("entity_type", F.lit("")), F.lit("): "), F.coalesce("description", F.lit("")))


def relation_line() -> Column:
    return F.concat(F.col("src"), F.lit(" -> "), F.col("tgt"), F.lit(": "), F.coalesce("keywords", F.lit("")), F.lit(" - "), F.coalesce("description", F.lit("")))


def chunk_block() -> Column:
    return F.concat(F.lit("["), F.coalesce(F.when(F.length("file_path") > 0, file_name(F.col("file_path"))), F.lit("unknown")), F.lit("]\n"), F.coalesce("content", F.lit("")))


def reference_line() -> Column:
    path = F.col("file_path")
    is_url = F.lower(path).startswith("http://") | F.lower(path).startswith("https://")
    return F.when(is_url, F.concat(F.lit("["), file_name(path), F.lit("]("), path, F.lit(")"))).otherwise(F.concat(F.lit("["), file_name(path), F.lit("] "), path))


def context_string(entities: DataFrame, relations: DataFrame, chunks: DataFrame, refs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, ``context``: sections that have rows, parted by a blank line. The lists are bounded by token budgets. With ``by`` one row for
    each question that has any."""
    parts = [
        entities.select(*by, F.lit(0).alias("section"), F.col("pos").cast("bigint").alias("at"), entity_line().alias("line")),
        relations.select(*by, F.lit(1).alias("section"), F.col("pos").cast("bigint").alias("at"), relation_line().alias("line")),
        chunks.select(*by, F.lit(2).alias("section"), F.col("pos").cast("bigint").alias("at"), chunk_block().alias("line")),
        refs.select(*by, F.lit(3).alias("section"), F.col("reference_id").cast("bigint").alias("at"), reference_line().alias("line")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    title = F.get(F.array(*(F.lit(t) for t in TITLES)), F.col("section"))
    sections = rows.groupBy(*by, "section").agg(lines.alias("lines"))
    sections = sections.select(*by, "section", F.concat(title, F.lit(":\n\n```\n"), F.when(F.col("section") == 2, F.array_join("lines", "\n\n")).otherwise(F.array_join("lines", "\n")), F.lit("\n```")).alias("body"))
    return (sections.groupBy(*by) if by else sections.groupBy()).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "body"))), lambda x: x["body"]), "\n\n").alias("context"))


def chat_history(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Messages of each conversation in order of turn: keys and messages, an array of (role, text)."""
    packed = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return rows.groupBy(*keys).agg(F.transform(packed, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))


def sse_events(rows: DataFrame) -> DataFrame:
    """Answer pieces (seq, text, error) as event payloads: text_chunk, error or a closing done; blank pieces fall out."""
    pieces = rows.filter(F.col("error").isNotNull() | (F.length(F.coalesce("text", F.lit(""))) > 0))
    body = F.when(F.col("error").isNotNull(), F.to_json(F.struct(F.lit("error").alias("type"), F.col("error").alias("message")))).otherwise(F.to_json(F.struct(F.lit("text_chunk").alias("type"), F.col("text").alias("content"))))
    done = rows.agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("seq")).select("seq", F.to_json(F.struct(F.lit("done").alias("type"))).alias("data"))
    return pieces.select("seq", body.alias("data")).unionByName(done)


def fold_sse(events: DataFrame) -> DataFrame:
    """One row, ``answer``: texts up to the first done or error."""
    parsed = events.select("seq", F.from_json("data", "type string, content string").alias("e"))
    end = parsed.agg(F.min(F.when(F.col("e.type") != "text_chunk", F.col("seq"))).alias("__end"))
    texts = parsed.join(F.broadcast(end), F.col("__end").isNull() | (F.col("seq") < F.col("__end")))  # end: one row
    return texts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "e.content"))), lambda x: x["content"]), "").alias("answer"))
