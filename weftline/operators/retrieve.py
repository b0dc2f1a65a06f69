"""Retrieval: ranked lists of entities, relations and chunks. Every ranked DataFrame carries ``pos``, from 0.

``by`` names the columns of a question's id, where lists of many questions are worked on at once: every list, quota and budget is then
one for each question, and windows are dealt by question. ``long`` marks lists without a limit: what is summed or numbered along them is then
worked out in blocks, so that no window holds a whole list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.ids import canonical
from ..functions.text import unpack
from ..functions.tokens import WORDS, Tokenizer
from ..session import BLOCK, numbered, running
from . import graph


By = tuple[str, ...]
#: Text chunks (chunk_id, content, file_path), or a function that looks up those of a list (chunk_id).
Texts = DataFrame | Callable[[DataFrame], DataFrame]


def ranked(df: DataFrame, *order: Column | str, by: By = ()) -> DataFrame:
    """df with pos by the order. For lists that a limit has bounded: the window has one partition, or one for each question."""
    return df.withColumn("pos", F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)


def block(c: str, size: int | None = None) -> Column:
    """The block of a place in a list."""
    return F.floor(F.col(c) / (size or BLOCK))


def _along(rows: DataFrame, name: str, value: Column, order: list[str], blocks: list[Column] | None, by: By) -> DataFrame:
    """rows with the running sum of a value along the order; by blocks where they are given."""
    if blocks is not None:
        return running(rows, value, blocks, [F.col(c) for c in order], by, name)
    return rows.withColumn(name, F.sum(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def _renumbered(rows: DataFrame, order: list[str], blocks: list[Column] | None, by: By) -> DataFrame:
    """rows with pos by the order, which has no ties."""
    return _along(rows, "pos", F.lit(1), order, blocks, by).withColumn("pos", (F.col("pos") - 1).cast("int"))


def weight(c: Column) -> Column:
    """An edge's weight as a number, 1 where it is none."""
    return F.coalesce(c.try_cast("double"), F.lit(1.0))


def local_entities(hits: DataFrame, nodes: DataFrame, edges: DataFrame | None = None, degrees: DataFrame | None = None, by: By = ()) -> DataFrame:
    """hits (pos, entity_id) of the entity store with their node and degree (rank); hits without a node or id fall out.

    Degrees (entity_id, degree) are counted over the edges if they are not given. Where a node has no description, type or path, those
    of the hit count, if the store has them; a description and a type are empty at the least.
    """
    shared = [c for c in ("description", "entity_type", "file_path") if c in hits.columns and c in nodes.columns]
    found = hits.filter(F.length("entity_id") > 0).select(*by, "pos", "entity_id", *(F.col(c).alias(f"__hit_{c}") for c in shared)).join(nodes, "entity_id")
    found = found.withColumns({c: F.coalesce(c, f"__hit_{c}", *([] if c == "file_path" else [F.lit("")])) for c in shared}).drop(*(f"__hit_{c}" for c in shared))
    deg = graph.node_degrees(edges, found, few=True) if degrees is None else degrees.select("entity_id", "degree")
    return found.join(deg, "entity_id", "left").withColumn("rank", F.coalesce("degree", F.lit(0))).drop("degree")


def local_relations(entities: DataFrame, edges: DataFrame, limit: int | None = None, degrees: DataFrame | None = None, by: By = ()) -> DataFrame:
    """Edges at the entities, each once, by rank (sum of degrees), then weight, then ends; of any number without a limit."""
    out = edges_at(entities, edges, degrees, by)
    order = (F.desc("rank"), F.desc("weight"), "src", "tgt")
    if by:
        rows = ranked(out, *order, by=by)
        return rows.filter(F.col("pos") < limit) if limit else rows
    return ranked(out.orderBy(*order).limit(limit), *order) if limit else numbered(out, *order)


def edges_at(entities: DataFrame, edges: DataFrame, degrees: DataFrame | None = None, by: By = ()) -> DataFrame:
    """Edges at the entities, each once, with weight and rank. ``degrees`` (entity_id, degree) of their ends, if they are kept."""
    ids = entities.select(*by, "entity_id").distinct()
    if by:
        pairs = edges.select("src", "tgt")
        near = pairs.join(ids.withColumnRenamed("entity_id", "src"), "src").unionByName(pairs.join(ids.withColumnRenamed("entity_id", "tgt"), "tgt")).distinct()
        ranks = near.join(graph.edge_degrees(edges, near.select("src", "tgt").distinct(), known=degrees), ["src", "tgt"])
    else:
        at = edges.join(ids.withColumnRenamed("entity_id", "src"), "src", "left_semi").select("src", "tgt")
        near = at.unionByName(edges.join(ids.withColumnRenamed("entity_id", "tgt"), "tgt", "left_semi").select("src", "tgt")).distinct()
        ranks = graph.edge_degrees(edges, near, few=True, known=degrees)
    return ranks.join(edges, ["src", "tgt"]).withColumn("weight", weight(F.col("weight")))


def global_relations(hits: DataFrame, edges: DataFrame, by: By = ()) -> DataFrame:
    """hits (pos, src, tgt) of the relation store with their edge, in the hit's order and orientation; rank 0."""
    low, high = canonical(F.col("src"), F.col("tgt"))
    asked = hits.filter((F.length("src") > 0) & (F.length("tgt") > 0)).select(*by, "pos", F.col("src").alias("hit_src"), F.col("tgt").alias("hit_tgt"), low.alias("src"), high.alias("tgt"))
    found = asked.join(edges, ["src", "tgt"]).drop("src", "tgt").withColumnsRenamed({"hit_src": "src", "hit_tgt": "tgt"})
    return found.withColumns({"weight": weight(F.col("weight")), "rank": F.lit(0).cast("bigint")})


def global_entities(relations: DataFrame, nodes: DataFrame, by: By = ()) -> DataFrame:
    """Ends of ranked relations, first seen first (source before target), with their node; rank 0."""
    ends = relations.select(*by, "pos", F.posexplode(F.array("src", "tgt")).alias("side", "entity_id"))
    first = ends.groupBy(*by, "entity_id").agg(F.min(F.struct("pos", "side")).alias("at"))
    found = first.join(nodes, "entity_id")
    return ranked(found, "at", by=by).drop("at").withColumn("rank", F.lit(0).cast("bigint"))


def round_robin(lists: list[DataFrame], key: list[str], by: By = (), long: bool = False) -> DataFrame:
    """Merge ranked lists by turns: at each place the first list's row, then the second's; the first row of a key stays."""
    every = None
    for i, rows in enumerate(lists):
        own = rows.withColumn("__list", F.lit(i))
        every = own if every is None else every.unionByName(own, allowMissingColumns=True)
    for k in key:
        every = every.filter(F.length(k) > 0)
    first = W.partitionBy(*by, *key).orderBy("pos", "__list")
    once = every.withColumn("__rn", F.row_number().over(first)).filter("__rn = 1")
    return _renumbered(once.withColumnRenamed("pos", "__pos"), ["__pos", "__list"], [block("__pos")] if long else None, by).drop("__pos", "__list", "__rn")


def merge_entities(local: DataFrame, global_: DataFrame, by: By = ()) -> DataFrame:
    return round_robin([local, global_], ["entity_id"], by)


def merge_relations(local: DataFrame, global_: DataFrame, by: By = (), long: bool = False) -> DataFrame:
    """Relations are one whatever their orientation; the first seen keeps its own."""
    pair = lambda df: df.withColumns(dict(zip(("__a", "__b"), canonical(F.col("src"), F.col("tgt")), strict=True)))
    return round_robin([pair(local), pair(global_)], ["__a", "__b"], by, long).drop("__a", "__b")


def token_budget(rows: DataFrame, text: Column, budget: int, tokenizer: Tokenizer = WORDS, by: By = (), long: bool = False) -> DataFrame:
    """The longest prefix of a ranked list whose tokens fit the budget."""
    counted = rows.withColumn("__n", tokenizer.count(text))
    return _along(counted, "__sum", F.col("__n"), ["pos"], [block("pos")] if long else None, by).filter(F.col("__sum") <= budget).drop("__n", "__sum")


def chunk_occurrence(items: DataFrame, packed: str = "source_id") -> DataFrame:
    """(chunk_id, n): how often chunks are named by the items."""
    return items.select(F.explode(unpack(F.col(packed))).alias("chunk_id")).groupBy("chunk_id").agg(F.count("*").alias("n"))


def item_chunks(items: DataFrame, packed: str, exclude: DataFrame | None = None, first_owner: bool = False, by: By = ()) -> DataFrame:
    """(item, chunk_id, k): each item's chunks, the most named first, then in the item's order.

    ``exclude`` (chunk_id) takes chunks away before counting. A chunk counts once in an item; with ``first_owner`` it belongs
    to the first item alone.
    """
    named = items.select(*by, F.col("pos").alias("item"), F.posexplode(unpack(F.col(packed))).alias("at", "chunk_id"))
    if exclude is not None:
        named = named.join(exclude.select(*by, "chunk_id").distinct(), [*by, "chunk_id"], "left_anti")
    n = named.groupBy(*by, "chunk_id").agg(F.count("*").alias("n"))
    # A chunk that very many items name is reduced to its first place before the shuffle.
    owner = [*by, "chunk_id"] if first_owner else [*by, "chunk_id", "item"]
    once = named.groupBy(*owner).agg(F.min(F.struct("item", "at")).alias("__first")).select(*by, "chunk_id", "__first.*")
    order = W.partitionBy(*by, "item").orderBy(F.desc("n"), "at")
    return once.join(n, [*by, "chunk_id"]).withColumn("k", F.row_number().over(order)).select(*by, "item", "chunk_id", "k")


def weighted_polling(chunks: DataFrame, most: int, least: int = 1, by: By = (), long: bool = False) -> DataFrame:
    """(item, chunk_id, k) -> the chosen chunks (pos, chunk_id), each once.

    Quotas fall in a line from ``most`` for the first item to ``least`` for the last, rounded half to even. What items leave
    goes to the earliest item with chunks to spare. What is summed up is one row for each item, not the chunks.
    """
    if not by:
        return weighted_polling(chunks.withColumn("__all", F.lit(0)), most, least, ("__all",), long).drop("__all")
    sizes = chunks.groupBy(*by, "item").agg(F.count("*").alias("size"))
    sizes = _along(sizes, "i", F.lit(1), ["item"], [block("item")] if long else None, by).withColumn("i", F.col("i") - 1)
    items = sizes.groupBy(*by).agg(F.count("*").alias("items"))
    sizes = sizes.join(items, list(by))
    line = F.lit(float(most)) - F.col("i").cast("double") / (F.col("items") - 1) * float(most - least)
    sizes = sizes.withColumn("quota", F.when(F.col("items") == 1, most).otherwise(F.bround(line)).cast("int"))
    spare = sizes.groupBy(*by).agg(F.sum(F.greatest(F.lit(0), F.col("quota") - F.col("size"))).alias("spare"))
    sizes = sizes.join(spare, list(by))
    # Chunks beyond the quotas take their turn by item: the first of an item comes after all those of earlier items.
    over = F.greatest(F.lit(0), F.col("size") - F.col("quota"))
    sizes = _along(sizes, "upto", over, ["i"], [block("i")] if long else None, by).withColumn("earlier", F.col("upto") - over)
    rows = chunks.join(sizes, [*by, "item"])
    late = rows.filter((F.col("k") > F.col("quota")) & (F.col("earlier") + F.col("k") - F.col("quota") <= F.col("spare")) & (F.col("items") > 1))
    chosen = rows.filter(F.col("k") <= F.col("quota")).select(*by, F.lit(0).alias("round"), "i", "k", "chunk_id").unionByName(late.select(*by, F.lit(1).alias("round"), "i", "k", "chunk_id"))
    first = chosen.groupBy(*by, "chunk_id").agg(F.min(F.struct("round", "i", "k")).alias("at")).select(*by, "chunk_id", "at.*")
    return _renumbered(first, ["round", "i", "k"], [F.col("round"), block("i")] if long else None, by).drop("round", "i", "k")


def with_content(chosen: DataFrame, text_chunks: Texts, by: By = (), long: bool = False) -> DataFrame:
    """Chosen chunks (pos, chunk_id) with content and file path; a chunk that is not stored falls out."""
    texts = text_chunks(chosen) if callable(text_chunks) else text_chunks
    found = chosen.join(texts.select("chunk_id", "content", "file_path"), "chunk_id")
    if long:  # texts last: only keys go through the numbering
        known = chosen.join(texts.select("chunk_id"), "chunk_id", "left_semi").withColumnRenamed("pos", "__pos")
        return _renumbered(known, ["__pos"], [block("__pos")], by).drop("__pos").join(texts.select("chunk_id", "content", "file_path"), "chunk_id")
    return _renumbered(found.withColumnRenamed("pos", "__pos"), ["__pos"], None, by).drop("__pos")


def related_chunks_entities(entities: DataFrame, text_chunks: Texts, most: int = 5, by: By = (), long: bool = False) -> DataFrame:
    return with_content(weighted_polling(item_chunks(entities, "source_id", by=by), most, by=by, long=long), text_chunks, by, long)


def related_chunks_relations(relations: DataFrame, text_chunks: Texts, entity_chunks: DataFrame, most: int = 5, by: By = (), long: bool = False) -> DataFrame:
    return with_content(weighted_polling(item_chunks(relations, "source_id", entity_chunks, True, by), most, by=by, long=long), text_chunks, by, long)


def merge_chunks(vector: DataFrame, entity: DataFrame, relation: DataFrame, by: By = (), long: bool = False) -> DataFrame:
    return round_robin([vector, entity, relation], ["chunk_id"], by, long)


def references(chunks: DataFrame, by: By = ()) -> tuple[DataFrame, DataFrame]:
    """(references, chunks): file paths by number of chunks, then first place, numbered from 1; chunks get their reference_id."""
    known = chunks.filter((F.length("file_path") > 0) & (F.col("file_path") != "unknown_source"))
    paths = known.groupBy(*by, "file_path").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    refs = paths.select(*by, F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), "first")).cast("string").alias("reference_id"), "file_path")
    numbered = chunks.join(refs, [*by, "file_path"], "left").withColumn("reference_id", F.coalesce("reference_id", F.lit("")))
    return refs, numbered


def empty_gate(entities: DataFrame, relations: DataFrame, chunks: DataFrame, mode: str) -> bool:
    """Whether there is anything to answer from: chunks alone are enough in the mode mix only."""
    if not entities.isEmpty() or not relations.isEmpty():
        return True
    return mode == "mix" and not chunks.isEmpty()
