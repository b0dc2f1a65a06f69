"""Merging extracted facts into nodes and edges, with the state of earlier merges.

Facts carry (chunk_ord, ord), the order in which they were found; all "first" below means that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.ids import canonical, prefixed_md5, relation_id
from ..functions.text import pack, unpack
from ..functions.tokens import token_count

FIFO, KEEP = "FIFO", "KEEP"
PATH_PLACEHOLDER = "...truncated..."
UNKNOWN = "UNKNOWN"


def limit_method(method: str | None) -> str:
    return KEEP if (method or "").upper() == KEEP else FIFO


def limit_ids(ids: Column, n: int, method: str = FIFO) -> Column:
    """The last n of an array (FIFO) or the first n (KEEP); none for n <= 0."""
    if n <= 0:
        return F.slice(ids, 1, 0)
    return F.when(F.size(ids) > n, F.slice(ids, -n, n) if limit_method(method) == FIFO else F.slice(ids, 1, n)).otherwise(ids)


def truncation_info(ids: Column, n: int, method: str = FIFO) -> Column:
    said = F.concat(F.lit("FIFO "), F.lit(str(n)), F.lit("/"), F.size(ids).cast("string")) if limit_method(method) == FIFO else F.lit("KEEP Old")
    return F.when(F.size(ids) > n, said).otherwise("")


def union_ids(old: Column, new: Column) -> Column:
    """Distinct ids, old ones first, without blank ones."""
    return F.array_distinct(F.filter(F.concat(old, new), lambda x: x.isNotNull() & (x != "")))


def limit_paths(old: Column, new: Column, n: int, method: str = FIFO) -> Column:
    """Distinct file paths, old ones first; of more than n the last (FIFO) or first n and a placeholder."""
    paths = union_ids(F.filter(old, lambda p: ~p.startswith(PATH_PLACEHOLDER)), new)
    fifo = limit_method(method) == FIFO
    mark = F.array(F.lit(PATH_PLACEHOLDER + ("(FIFO)" if fifo else "(KEEP Old)")))
    return F.when(F.size(paths) > n, F.concat(F.slice(paths, -n, n) if fifo else F.slice(paths, 1, n), mark)).otherwise(paths)


def merge_keywords(packed: Column) -> Column:
    """Array of comma-separated keywords -> distinct ones in byte order, joined by commas."""
    every = F.flatten(F.transform(packed, lambda k: F.split(F.coalesce(k, F.lit("")), ",")))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(every, lambda k: F.trim(k)), lambda k: k != ""))), ",")


def _distinct_in_order(facts: DataFrame, key: list[str], value: str, name: str) -> DataFrame:
    """key and the distinct values, the first found first. Repeats fall away before the shuffle, so that no list has them."""
    first = facts.groupBy(*key, F.col(value).alias("v")).agg(F.min(F.struct("chunk_ord", "ord")).alias("at"))
    return first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias(name))


def type_vote(facts: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(name, entity_type): the most frequent type, an existing node's type having one vote; ties go to the first seen."""
    votes = facts.filter(F.length(F.trim("type")) > 0).select("name", "type", "chunk_ord", "ord")
    if existing is not None:
        late = F.lit(2**31 - 1)
        votes = votes.unionByName(existing.filter(F.length(F.trim("entity_type")) > 0).select(F.col("entity_id").alias("name"), F.col("entity_type").alias("type"), late.alias("chunk_ord"), late.alias("ord")))
    counted = votes.groupBy("name", "type").agg(F.count("*").alias("n"), F.min(F.struct("chunk_ord", "ord")).alias("first"))
    best = F.row_number().over(W.partitionBy("name").orderBy(F.desc("n"), "first"))
    won = counted.withColumn("rn", best).filter("rn = 1").select("name", F.col("type").alias("entity_type"))
    return facts.select("name").distinct().join(won, "name", "left").select("name", F.coalesce("entity_type", F.lit(UNKNOWN)).alias("entity_type"))


def ordered_descriptions(facts: DataFrame, key: list[str]) -> DataFrame:
    """key and descriptions: distinct, by time, then longest first, then first seen."""
    first = facts.filter(F.length(F.trim("description")) > 0).groupBy(*key, "description").agg(F.min(F.struct("chunk_ord", "ord", "timestamp")).alias("at"))
    once = first.select(*key, "description", "at.*")
    place = F.struct("timestamp", (-F.char_length("description")).alias("shorter"), "chunk_ord", "ord", "description")
    return once.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["description"]).alias("descriptions"))


def join_descriptions(parts: Column, max_parts: int = 8, max_tokens: int = 1200) -> tuple[Column, Column]:
    """(joined text, whether a summary is due instead). Few and short parts are joined; the others are for a summariser."""
    tokens = F.aggregate(parts, F.lit(0), lambda s, x: s + token_count(x))
    due = (F.size(parts) > 1) & ((F.size(parts) >= max_parts) | (tokens >= max_tokens))
    return F.when(F.size(parts) == 0, "").otherwise(pack(parts)), due


def description_groups(parts: Column, context: int = 12_000) -> Column:
    """Array of parts -> array of arrays: filled in order up to ``context`` tokens, each with two parts where there are."""
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        n = token_count(x)
        over = (acc["n"] + n > context) & (F.size(acc["open"]) > 0)
        forced = F.struct(F.array_append(acc["done"], F.array_append(acc["open"], x)).alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"))
        closed = F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), F.array(x).alias("open"), n.alias("n"))
        grown = F.struct(acc["done"].alias("done"), F.array_append(acc["open"], x).alias("open"), (acc["n"] + n).alias("n"))
        return F.when(over & (F.size(acc["open"]) == 1), forced).when(over, closed).otherwise(grown)

    return F.aggregate(parts, start, step, lambda acc: F.when(F.size(acc["open"]) > 0, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]))


def keep_filter(facts: DataFrame, allowed: DataFrame, known: DataFrame) -> DataFrame:
    """Facts whose chunk is blank, among the allowed (key, chunk_id), or already known (key, chunk_id)."""
    pairs = allowed.select("name", F.col("chunk_id").alias("source_id")).unionByName(known.select("name", F.col("chunk_id").alias("source_id"))).distinct().withColumn("__ok", F.lit(True))
    return facts.join(pairs, ["name", "source_id"], "left").filter(F.col("__ok") | (F.coalesce("source_id", F.lit("")) == "")).drop("__ok")


def merge_entities(facts: DataFrame, existing: DataFrame | None = None, max_sources: int = 300, method: str = FIFO, max_paths: int = 100) -> DataFrame:
    """facts (name, type, description, source_id, file_path, timestamp, chunk_ord, ord) and existing nodes -> merged nodes.

    Entities without any description fall out. ``source_ids`` keeps all ids, ``source_id`` the limited list.
    """
    grouped = _distinct_in_order(facts, ["name"], "source_id", "new_ids").join(_distinct_in_order(facts, ["name"], "file_path", "new_paths"), "name")
    merged = grouped.join(type_vote(facts, existing), "name").join(ordered_descriptions(facts, ["name"]), "name", "left")
    none = F.array().cast("array<string>")
    if existing is not None:
        old = existing.select(F.col("entity_id").alias("name"), unpack(F.col("source_id")).alias("old_ids"), unpack(F.col("file_path")).alias("old_paths"), unpack(F.col("description")).alias("old_parts"))
        merged = merged.join(old, "name", "left")
    else:
        merged = merged.withColumns({"old_ids": none, "old_paths": none, "old_parts": none})
    merged = merged.withColumns({c: F.coalesce(c, none) for c in ("old_ids", "old_paths", "old_parts", "descriptions")})
    parts = F.array_distinct(F.concat("old_parts", "descriptions"))
    ids = union_ids(F.col("old_ids"), F.col("new_ids"))
    merged = merged.withColumns({"parts": parts, "ids": ids}).filter(F.size("parts") > 0)
    text, due = join_descriptions(F.col("parts"))
    return merged.select(
        F.col("name").alias("entity_id"), "entity_type", text.alias("description"), due.alias("needs_summary"),
        pack(limit_ids(F.col("ids"), max_sources, method)).alias("source_id"), truncation_info(F.col("ids"), max_sources, method).alias("truncate"),
        pack(limit_paths(F.col("old_paths"), F.col("new_paths"), max_paths, method)).alias("file_path"), F.col("ids").alias("source_ids"),
        prefixed_md5("ent-", F.col("name")).alias("id"), F.concat(F.col("name"), F.lit("\n"), text).alias("content"),
    )


def merge_relations(facts: DataFrame, existing: DataFrame | None = None, max_sources: int = 300, method: str = FIFO, max_paths: int = 100) -> DataFrame:
    """facts (source_id, target_id, keywords, description, weight, source_chunk_id, file_path, timestamp, chunk_ord, ord) and edges -> edges.

    Self-loops fall out; weights add up, over earlier merges too.
    """
    low, high = canonical(F.col("source_id"), F.col("target_id"))
    facts = facts.filter("source_id <> target_id").withColumns({"src": low, "tgt": high})
    key = ["src", "tgt"]
    grouped = facts.groupBy(*key).agg(F.collect_set("keywords").alias("words"), F.sum(F.col("weight").cast("double")).alias("new_weight"))
    for value, name in (("source_chunk_id", "new_ids"), ("file_path", "new_paths")):
        grouped = grouped.join(_distinct_in_order(facts, key, value, name), key)
    merged = grouped.join(ordered_descriptions(facts, key), key, "left")
    none = F.array().cast("array<string>")
    if existing is not None:
        old = existing.select(*key, unpack(F.col("source_id")).alias("old_ids"), unpack(F.col("file_path")).alias("old_paths"), unpack(F.col("description")).alias("old_parts"), F.array("keywords").alias("old_words"), F.col("weight").cast("double").alias("old_weight"))
        merged = merged.join(old, key, "left")
    else:
        merged = merged.withColumns({"old_ids": none, "old_paths": none, "old_parts": none, "old_words": none, "old_weight": F.lit(0.0)})
    merged = merged.withColumns({c: F.coalesce(c, none) for c in ("old_ids", "old_paths", "old_parts", "old_words", "descriptions")})
    merged = merged.withColumns({"parts": F.array_distinct(F.concat("old_parts", "descriptions")), "ids": union_ids(F.col("old_ids"), F.col("new_ids"))}).filter(F.size("parts") > 0)
    text, due = join_descriptions(F.col("parts"))
    words = merge_keywords(F.concat("old_words", "words"))
    return merged.select(
        *key, words.alias("keywords"), text.alias("description"), due.alias("needs_summary"), (F.col("new_weight") + F.coalesce("old_weight", F.lit(0.0))).alias("weight"),
        pack(limit_ids(F.col("ids"), max_sources, method)).alias("source_id"), truncation_info(F.col("ids"), max_sources, method).alias("truncate"),
        pack(limit_paths(F.col("old_paths"), F.col("new_paths"), max_paths, method)).alias("file_path"), F.col("ids").alias("source_ids"),
        relation_id(F.col("src"), F.col("tgt")).alias("id"), F.concat(words, F.lit("\t"), F.col("src"), F.lit("\n"), F.col("tgt"), F.lit("\n"), text).alias("content"),
    )


def missing_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes for ends of edges that have none: type UNKNOWN, the edges' distinct sources, descriptions and paths in order of the pair."""
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("entity_id"), F.struct("src", "tgt").alias("at"), "source_id", "description", "file_path")
    ends = ends.join(nodes.select("entity_id"), "entity_id", "left_anti")
    # One list for each end carries all that its edges say: what is gathered and sorted is each pair once,
    # not once for each column. sort_array compares rows by itself; array_sort would call a function for each comparison.
    every = ends.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("at", "source_id", "description", "file_path"))).alias("__of"))
    distinct = lambda c: F.array_distinct(F.filter(F.transform(F.sort_array(F.transform("__of", lambda x: F.struct(x["at"].alias("at"), x[c].alias("v")))), lambda x: x["v"]), lambda v: v != ""))
    out = every.select("entity_id", distinct("source_id").alias("s"), distinct("description").alias("d"), distinct("file_path").alias("f"))
    return out.select("entity_id", F.lit(UNKNOWN).alias("entity_type"), F.when(F.size("d") > 0, pack(F.col("d"))).otherwise(F.col("entity_id")).alias("description"), pack(F.col("s")).alias("source_id"), pack(F.col("f")).alias("file_path"), F.lit(False).alias("has_vector"))


def stale_relation_vectors(store: DataFrame, relations: DataFrame) -> DataFrame:
    """store (id, ...) with ``stale``: whether it is a vector of one of the relations, in either direction."""
    ids = relations.select(F.explode(F.array(relation_id(F.col("src"), F.col("tgt")), relation_id(F.col("tgt"), F.col("src")))).alias("id")).distinct()
    return store.join(ids.withColumn("__stale", F.lit(True)), "id", "left").withColumn("stale", F.coalesce("__stale", F.lit(False))).drop("__stale")


def replace_relation_vectors(store: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(store without vectors of the relations in either direction, the ids (id) that were there)."""
    marked = stale_relation_vectors(store, relations)
    return marked.filter("not stale").drop("stale"), marked.filter("stale").select("id").distinct()


def document_index(entity_facts: DataFrame, relation_facts: DataFrame) -> DataFrame:
    """(full_doc_id, entity_names, n_entities, relation_pairs, n_relations): what each document contributed; relation ends count as entities."""
    low, high = canonical(F.col("source_id"), F.col("target_id"))
    pairs = relation_facts.filter("source_id <> target_id").select("full_doc_id", low.alias("src"), high.alias("tgt")).distinct()
    names = entity_facts.select("full_doc_id", "name").unionByName(pairs.select("full_doc_id", F.explode(F.array("src", "tgt")).alias("name"))).distinct()
    a = names.groupBy("full_doc_id").agg(F.array_sort(F.collect_list("name")).alias("entity_names"))
    b = pairs.groupBy("full_doc_id").agg(F.array_sort(F.collect_list(F.struct("src", "tgt"))).alias("relation_pairs"))
    none = F.array().cast("array<struct<src:string,tgt:string>>")
    out = a.join(b, "full_doc_id", "left").withColumn("relation_pairs", F.coalesce("relation_pairs", none))
    return out.withColumns({"n_entities": F.size("entity_names"), "n_relations": F.size("relation_pairs")})


