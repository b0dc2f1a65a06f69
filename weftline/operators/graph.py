"""The knowledge graph: nodes (entity_id, entity_type, description, labels, ...) and edges (src < tgt, weight, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import canonical

MAX_DEPTH, MAX_NODES = 5, 1000
#: Colours by entity type (fixed values).
TYPE_COLORS = {
    "person": "#FF6B6B", "organization": "#4ECDC4", "location": "#95E1D3", "concept": "#F38181", "event": "#AA96DA", "method": "#FCBAD3",
    "content": "#A8DADC", "data": "#FFD93D", "artifact": "#6BCB77", "naturalobject": "#4D96FF", "creature": "#9B59B6",
}


def nodes_batch(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes named by ids (entity_id), each once."""
    return nodes.join(ids.select("entity_id").distinct(), "entity_id", "left_semi")


def edges_batch(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges of unordered pairs (src, tgt), under the caller's orientation."""
    low, high = canonical(F.col("src"), F.col("tgt"))
    asked = pairs.select(F.col("src").alias("asked_src"), F.col("tgt").alias("asked_tgt"), low.alias("src"), high.alias("tgt")).distinct()
    return asked.join(edges, ["src", "tgt"]).drop("src", "tgt").withColumnsRenamed({"asked_src": "src", "asked_tgt": "tgt"})


def has_edge(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (src, tgt) with has_edge."""
    low, high = canonical(F.col("src"), F.col("tgt"))
    known = edges.select(F.col("src").alias("__a"), F.col("tgt").alias("__b")).distinct().withColumn("__yes", F.lit(True))
    return pairs.join(known, (low == F.col("__a")) & (high == F.col("__b")), "left").select("src", "tgt", F.coalesce("__yes", F.lit(False)).alias("has_edge"))


def degrees(edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(entity_id, degree) of all nodes with edges, or of those ``of`` (entity_id) names. Ends are counted before the shuffle.

    A short list of nodes is best given: then only their ends are counted, and a broadcast join picks them.
    """
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("entity_id"))
    if of is not None:
        ends = ends.join(of.select("entity_id").distinct(), "entity_id", "left_semi")
    return ends.groupBy("entity_id").agg(F.count("*").alias("degree"))


def node_degrees(edges: DataFrame, ids: DataFrame, few: bool = False) -> DataFrame:
    """Degrees of the given ids (entity_id), 0 where there is no edge. ``few``: the ids are a short list."""
    return ids.select("entity_id").distinct().join(degrees(edges, ids if few else None), "entity_id", "left").select("entity_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def edge_degrees(edges: DataFrame, pairs: DataFrame, few: bool = False, known: DataFrame | None = None) -> DataFrame:
    """pairs (src, tgt) with rank, the sum of both ends' degrees. ``few``: the pairs are a short list; ``known``: degrees that are kept."""
    deg = known if known is not None else degrees(edges, pairs.select(F.explode(F.array("src", "tgt")).alias("entity_id")) if few else None)
    out = pairs.join(deg.withColumnsRenamed({"entity_id": "src", "degree": "__a"}), "src", "left").join(deg.withColumnsRenamed({"entity_id": "tgt", "degree": "__b"}), "tgt", "left")
    return out.select("src", "tgt", (F.coalesce("__a", F.lit(0)) + F.coalesce("__b", F.lit(0))).alias("rank"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(entity_id, neighbour) in both directions."""
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("entity_id"), F.col("tgt").alias("neighbour")), F.struct(F.col("tgt").alias("entity_id"), F.col("src").alias("neighbour")))).alias("e")).select("e.*")


def node_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (entity_id) with one row per neighbour; a node without edges has one row with a null neighbour."""
    return ids.select("entity_id").distinct().join(both_ways(edges), "entity_id", "left")


def labels(nodes: DataFrame, workspace: str | None = None) -> DataFrame:
    """Distinct labels besides the workspace's own."""
    every = nodes.select(F.explode("labels").alias("label"))
    return (every.filter(F.col("label") != workspace) if workspace else every).distinct()


def popular_labels(nodes: DataFrame, workspace: str | None = None, limit: int = 300) -> DataFrame:
    """Labels with the most nodes."""
    every = nodes.select(F.explode("labels").alias("label"))
    every = every.filter(F.col("label") != workspace) if workspace else every
    return every.groupBy("label").agg(F.count("*").alias("n_nodes")).orderBy(F.desc("n_nodes"), "label").limit(limit)


def match_label(nodes: DataFrame, label: str) -> DataFrame:
    """Nodes whose id contains the label or whose type is the label; ``*`` is every node with an id."""
    return nodes.filter(F.col("entity_id").isNotNull()) if label == "*" else nodes.filter(F.col("entity_id").contains(label) | (F.col("entity_type") == label))


def upsert_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Property by property, the change's non-null values win; labels gather, with the change's type or ``Entity``.

    changes: some of the nodes' columns besides labels, one row per entity_id.
    """
    new = changes.withColumn("__label", F.coalesce("entity_type", F.lit("Entity")) if "entity_type" in changes.columns else F.lit("Entity"))
    joined = nodes.alias("o").join(new.alias("n"), "entity_id", "full_outer")
    columns = ["entity_id"]
    for c in nodes.columns:
        if c == "labels":
            merged = F.array_union(F.coalesce("o.labels", F.array().cast("array<string>")), F.when(F.col("n.__label").isNotNull(), F.array("n.__label")).otherwise(F.array().cast("array<string>")))
            columns.append(merged.alias("labels"))
        elif c != "entity_id":
            columns.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in changes.columns else F.col(f"o.{c}").alias(c))
    return joined.select(*columns)


def upsert_edges(nodes: DataFrame, edges: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after changes (src, tgt, properties), one row per unordered pair: ends exist and gain ``Entity``."""
    low, high = canonical(F.col("src"), F.col("tgt"))
    new = changes.withColumns({"src": low, "tgt": high})
    ends = new.select(F.explode(F.array("src", "tgt")).alias("entity_id")).distinct()
    joined = edges.alias("o").join(new.alias("n"), ["src", "tgt"], "full_outer")
    columns: list[Column | str] = ["src", "tgt"]
    columns += [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in changes.columns else F.col(f"o.{c}").alias(c) for c in edges.columns if c not in ("src", "tgt")]
    return upsert_nodes(nodes, ends), joined.select(*columns)


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the ids (entity_id) and their edges."""
    gone = ids.select("entity_id").distinct()
    left = edges.join(gone.withColumnRenamed("entity_id", "src"), "src", "left_anti").join(gone.withColumnRenamed("entity_id", "tgt"), "tgt", "left_anti")
    return nodes.join(gone, "entity_id", "left_anti"), left


def remove_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    low, high = canonical(F.col("src"), F.col("tgt"))
    return edges.join(pairs.select(low.alias("src"), high.alias("tgt")).distinct(), ["src", "tgt"], "left_anti")


def subgraph_pairs(nodes: DataFrame, edges: DataFrame, label: str, depth: int, max_paths: int) -> DataFrame:
    """Pairs (start, connected, depth) reached from matching nodes along up to ``depth`` edges, none of them used twice on a path.

    Edges are one for each pair. A pair is kept with its smallest depth; at most ``max_paths`` pairs, nearest first. Levels are
    joined one by one and stop as soon as there are enough pairs, so that the frontier has fewer than ``max_paths`` pairs
    and travels as a broadcast: hubs add rows to a level's join, never to the next level. To find the way back to a start, each pair
    keeps the first steps of its two nearest paths: a closed path ends by another edge than it began with.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be 1 to {MAX_DEPTH}")
    spark = edges.sparkSession
    steps = both_ways(edges.select("src", "tgt").filter("src <> tgt")).withColumnsRenamed({"entity_id": "at", "neighbour": "to"})
    seeds = match_label(nodes, label).select(F.col("entity_id").alias("start")).distinct()
    near = seeds.join(steps, F.col("start") == F.col("at")).select("start", F.col("to").alias("connected")).orderBy("start", "connected").limit(max_paths)
    pairs = {(r["start"], r["connected"]): 1 for r in near.collect()}  # at most max_paths, as all that is collected below
    branches = {(s, c): [c] for s, c in pairs}
    frontier = [(s, c, c) for s, c in pairs]
    for level in range(2, depth + 1):
        if len(pairs) >= max_paths or not frontier:
            break
        reached = spark.createDataFrame(frontier, "start string, first string, last string")
        seen = spark.createDataFrame([(s, c, b) for (s, c), firsts in branches.items() for b in firsts], "start string, connected string, first string")
        full = spark.createDataFrame([(s, c) for (s, c), firsts in branches.items() if len(firsts) > 1], "start string, connected string")
        known = spark.createDataFrame(list(pairs), "start string, connected string").withColumn("known", F.lit(True))
        walked = steps.join(F.broadcast(reached), F.col("at") == F.col("last")).select("start", F.col("to").alias("connected"), "first", "last")
        # Back at the start by the first edge is no path.
        walked = walked.filter((F.col("connected") != F.col("start")) | (F.col("first") != F.col("last")))
        walked = walked.join(F.broadcast(seen), ["start", "connected", "first"], "left_anti").join(F.broadcast(full), ["start", "connected"], "left_anti")
        ends = walked.groupBy("start", "connected").agg(F.min("first").alias("a"), F.max("first").alias("b"))
        ends = ends.join(F.broadcast(known), ["start", "connected"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
        frontier = []
        # New pairs come first: fewer than max_paths of them, and all known ones, fit in.
        for r in ends.orderBy("known", "start", "connected").limit(2 * max_paths).collect():
            pair = (r["start"], r["connected"])
            pairs.setdefault(pair, level)
            if pair[0] != pair[1]:
                firsts = [b for b in dict.fromkeys((r["a"], r["b"]))][: 2 - len(branches.get(pair, []))]
                branches.setdefault(pair, []).extend(firsts)
                frontier += [(pair[0], b, pair[1]) for b in firsts]
    best = sorted(((s, c, n) for (s, c), n in pairs.items()), key=lambda r: (r[2], r[0].encode(), r[1].encode()))
    return spark.createDataFrame(best[:max_paths], "start string, connected string, depth int")


def subgraph(nodes: DataFrame, edges: DataFrame, label: str, depth: int = 3, max_nodes: int = MAX_NODES, mode: str = "reachability") -> tuple[DataFrame, DataFrame, bool]:
    """(nodes, edges, is_truncated). ``reachability``: an edge for every reached pair; ``induced``: stored edges between the nodes."""
    if not 1 <= max_nodes <= MAX_NODES:
        raise ValueError(f"max_nodes must be 1 to {MAX_NODES}")
    pairs = subgraph_pairs(nodes, edges, label, depth, max_nodes)
    ends = pairs.select(F.explode(F.array("start", "connected")).alias("entity_id"), "depth").groupBy("entity_id").agg(F.min("depth").alias("depth"))
    kept = ends.orderBy("depth", "entity_id").limit(max_nodes)
    out_nodes = nodes.join(F.broadcast(kept.select("entity_id")), "entity_id", "left_semi")  # at most MAX_NODES
    names = kept.select("entity_id")
    inside = lambda df, a, b: df.join(F.broadcast(names.withColumnRenamed("entity_id", a)), a, "left_semi").join(F.broadcast(names.withColumnRenamed("entity_id", b)), b, "left_semi")
    out_edges = inside(pairs.select(F.col("start").alias("src"), F.col("connected").alias("tgt")), "src", "tgt") if mode == "reachability" else inside(edges, "src", "tgt")
    return out_nodes, out_edges, ends.count() > max_nodes


def view(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes for display: short label, colour by type (by the label's checksum for other types), size by degree."""
    colors = F.create_map(*(F.lit(x) for pair in TYPE_COLORS.items() for x in pair))
    palette = F.array(*(F.lit(c) for c in TYPE_COLORS.values()))
    label = F.when(F.char_length("entity_id") > 20, F.concat(F.left("entity_id", F.lit(17)), F.lit("..."))).otherwise(F.col("entity_id"))
    shown = nodes.join(degrees(edges), "entity_id", "left").withColumn("label", label)
    fallback = F.get(palette, F.pmod(F.crc32("label"), F.lit(len(TYPE_COLORS))).cast("int"))
    size = F.greatest(F.lit(8.0), F.least(F.lit(35.0), 8 + 4 * F.sqrt(F.coalesce("degree", F.lit(0)).cast("double"))))
    return shown.select("entity_id", "label", "entity_type", F.coalesce(F.element_at(colors, F.lower("entity_type")), fallback).alias("color"), size.alias("size"))
