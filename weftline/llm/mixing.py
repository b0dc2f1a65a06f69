"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). Each pattern offers its words once
for free and again at a rising cost, up to ``max_repeats`` times; each source has a quota. The flow of least cost from
patterns to quotas says how many words each pattern gives. Inside a pattern every document is taken ``floor`` times and
a seeded part of them once more.

Targets: the sources by code point, null last, weigh ``weights`` in turn and share all words; none gets more than
``max_repeats`` times its own words, and the excess is shared again by weight.

Nothing that grows with the number of sources or patterns reaches the driver. Targets come from a few rounds of sums over the
sources. A pattern of one source that shares no document with another gives what its quota asks; sources that share documents
are linked, and the flow of each connected part is found in a task of its own, from one row for each pattern and source in it
(about a kilobyte of memory for each). Up to ``max_patterns`` patterns, and 64 MB of their names, the plan is broadcast; beyond
that it is joined by a shuffle, but for the at most 1000 patterns that hold a thousandth of all rows each. The rows are the same either way.

The seeded part is found by a histogram of hashes per pattern, so that no source, however large, is
sorted in one task: only the different documents of the one histogram cell where the quota ends are put in order. The decision
is a threshold, and for the room left after it a few single documents per pattern, largest first; documents themselves are
never shuffled, but for rows equal to one of those few.

Nulls and odd input: a null or blank text has size 0 and is taken as often as its pattern's floor, which adds 0 words; a
null source is a source of its own; a document without any source is not taken, and has no target; rows of one id and size are separate documents, of which as many are taken as fit
(which of them, where they differ otherwise, depends on how the table is partitioned); an empty table gives an empty result; other
columns are kept, but for columns named like the new ones, which are replaced. Documents are taken whole: a source's words
miss its target by less than one document; up to ``SPARES`` documents of each size are tried on the room that is left.
"""

from __future__ import annotations

import heapq
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import numbered
from .common import Scratch, without
from .components import components

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
CELLS = 1 << 12
#: Documents of one size that may fill the room after the threshold.
SPARES = 8


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sources (s, words, pos: place in the order of sources) -> with target, the words that each should give.

    A source is full if its cap is less than its part of what the full ones leave. Each round sums the full ones' caps and the others' weights; the
    parts only grow, so full sources stay full, and the rounds end when no source joins them.
    """
    exact = lambda c: c.cast("decimal(38,0)")
    weight = F.element_at(F.array(*(F.lit(w).cast("bigint") for w in weights)), F.pmod("pos", F.lit(len(weights))) + 1)
    cap = F.col("words") * max_repeats
    first = sources.agg(F.sum("words").alias("words"), F.sum(weight).alias("shares")).first()
    total, state = first["words"] or 0, None
    left, shares = total, first["shares"] or 0
    while state != (left, shares):
        state = left, shares
        full = exact(cap) * exact(F.lit(shares)) < exact(F.lit(left)) * exact(weight)
        now = sources.agg(F.sum(F.when(full, cap)).alias("caps"), F.sum(F.when(~full, weight)).alias("shares")).first()
        left, shares = total - (now["caps"] or 0), now["shares"] or 0
    return sources.withColumn("target", F.when(full, cap.cast("double")).otherwise(F.lit(left).cast("double") * weight / F.lit(shares)))


def route(patterns: dict[tuple, int], quotas: dict, max_repeats: int = MAX_REPEATS) -> dict[tuple, int]:
    """Words each pattern gives. Successive cheapest augmenting paths; the k-th repetition of a pattern costs k - 1.

    Steps between patterns and sources are free, so a path's cost is that of the repetition it starts with. Where a search
    finds no source with room, all it reached stays without: no later search enters it again.
    """
    quota = {s: round(q) for s, q in quotas.items()}
    given, got = dict.fromkeys(patterns, 0), dict.fromkeys(quota, 0)
    senders: dict = {s: {} for s in quota}  # source -> pattern -> words
    closed: set = set()
    waiting = [(0, str(p), p) for p in patterns]
    heapq.heapify(waiting)
    while waiting:
        layer, name, start = heapq.heappop(waiting)
        came: dict = {("p", start): None}
        queue, end = deque([("p", start)]), None
        while queue and ("p", start) not in closed:
            kind, node = at = queue.popleft()
            if kind == "s" and got[node] < quota[node]:
                end = at
                break
            for step in [("s", s) for s in node if s in quota] if kind == "p" else [("p", p) for p in senders[node]]:
                if step not in came and step not in closed:
                    came[step] = at
                    queue.append(step)
        if end is None:
            closed.update(came)
            continue
        path = [end]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        room = [(layer + 1) * patterns[start] - given[start], quota[end[1]] - got[end[1]]]
        amount = min(room + [senders[a[1]][b[1]] for a, b in zip(path, path[1:], strict=False) if a[0] == "s"])
        for a, b in zip(path, path[1:], strict=False):
            if a[0] == "p":
                senders[b[1]][a[1]] = senders[b[1]].get(a[1], 0) + amount
            else:
                senders[a[1]][b[1]] -= amount
                if not senders[a[1]][b[1]]:
                    del senders[a[1]][b[1]]
        given[start] += amount
        got[end[1]] += amount
        layer = given[start] // patterns[start]
        if layer < max_repeats:
            heapq.heappush(waiting, (layer, name, start))
    return given


def _given(patterns: DataFrame, sources: DataFrame, scratch: Scratch, max_repeats: int) -> DataFrame:
    """(__weft_p, given): the words that patterns (__weft_p, __weft_m, words) give to sources (s, pos, target)."""
    known = sources.select("s", "pos", "target")
    alone = F.least(F.col("words") * max_repeats, F.bround("target").cast("bigint"))
    first = lambda df: df.withColumn("s", F.col("__weft_m")[0]).join(known, "s")
    several = patterns.filter((F.size("__weft_m") > 1) & (F.col("words") > 0))
    if several.isEmpty():
        return first(patterns).select("__weft_p", alone.alias("given"))
    others = first(several).select(F.col("pos").alias("a"), F.explode(F.slice("__weft_m", 2, F.size("__weft_m"))).alias("s"))
    links = others.join(known.select("s", F.col("pos").alias("b")), "s").select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))
    roots = components(links, scratch, "linked")
    part = scratch.keep(known.join(roots, F.col("pos") == F.col("node"), "left").drop("node"), "parts", small=True)
    edges = patterns.filter("words > 0").select("__weft_p", "words", F.explode("__weft_m").alias("s")).join(part, "s")

    def flow(rows: pd.DataFrame) -> pd.DataFrame:
        return _route_part(rows, max_repeats)

    linked = edges.filter("root IS NOT NULL").select("root", "__weft_p", "words", "pos", "target")
    by_flow = linked.groupBy("root").applyInPandas(flow, "__weft_p string, given bigint")
    return edges.filter("root IS NULL").select("__weft_p", alone.alias("given")).unionByName(by_flow)


def _route_part(rows: pd.DataFrame, max_repeats: int) -> pd.DataFrame:
    """The flow of one connected part, from a row for each pattern and source in it."""
    rows = rows.sort_values(["__weft_p", "pos"])
    members: dict[str, list[int]] = {}
    for p, source in zip(rows["__weft_p"], rows["pos"], strict=True):
        members.setdefault(p, []).append(source)
    words = dict(zip(rows["__weft_p"], rows["words"], strict=True))
    given = route({tuple(m): int(words[p]) for p, m in members.items()}, dict(zip(rows["pos"], rows["target"], strict=True)), max_repeats)
    return pd.DataFrame({"__weft_p": list(members), "given": [given[tuple(m)] for m in members.values()]})


#: The plan of patterns is broadcast up to this size of their names.
MAX_NAMES = 64 << 20


def _planned(df: DataFrame, plan: DataFrame, wide: bool) -> DataFrame:
    """df with the plan of its pattern. ``wide``: only the patterns of very many rows are broadcast, at most 1000."""
    if not wide:
        return df.join(F.broadcast(plan), "__weft_p")
    hot = F.broadcast(plan.filter("__weft_hot"))
    rest = df.join(F.broadcast(plan.filter("__weft_hot").select("__weft_p")), "__weft_p", "left_anti")
    return df.join(hot, "__weft_p").unionByName(rest.join(plan.filter("not __weft_hot"), "__weft_p"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", memberships: Column | None = None, seed: int = 7, max_patterns: int = 200_000, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """docs and the columns size, source_size, target (of the first membership), repeats and taken."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    docs = without(docs, "source_size", "target", "repeats", "taken")
    member = F.array(F.col("source")) if memberships is None else memberships
    coded = F.array_sort(F.array_distinct(F.transform(member, lambda s: F.coalesce(F.concat(F.lit("s"), s), F.lit("z")))))
    coded = F.coalesce(coded, F.array().cast("array<string>"))
    placed = docs.withColumns({"__weft_m": coded, "__weft_h": F.xxhash64(F.lit(seed), F.col(id_col))})
    placed = placed.withColumn("__weft_h", F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(seed), F.col(text))).otherwise(F.col("__weft_h")))
    name = F.array_join(F.transform("__weft_m", lambda s: F.replace(s, F.lit("\u0001"), F.lit("\u0001\u0001"))), "\u0001")
    placed = placed.withColumns({"__weft_p": name, "__weft_cell": F.pmod(F.shiftright("__weft_h", 20), F.lit(CELLS))})
    sized = lambda df: df.withColumn("size", n_words(F.col(text))).withColumn("__weft_at", F.struct("__weft_cell", "__weft_h", "size", F.col(id_col).alias("__weft_id")))
    small = scratch.keep(sized(placed).select("__weft_p", "__weft_m", "__weft_at"), "sizes")
    cells = small.groupBy("__weft_p", "__weft_m", F.col("__weft_at.__weft_cell").alias("__weft_cell")).agg(F.sum("__weft_at.size").alias("words"), F.count("*").alias("rows"))
    small = small.drop("__weft_m")
    patterns = scratch.keep(cells.groupBy("__weft_p", "__weft_m").agg(F.sum("words").alias("words"), F.sum("rows").alias("rows")), "patterns", small=True)
    cells = cells.drop("rows")
    seen = patterns.agg(F.count("*").alias("n"), F.sum("rows").alias("rows"), F.sum(F.when(F.size("__weft_m") > 0, F.col("words"))).alias("words"), F.sum(F.octet_length("__weft_p")).alias("bytes")).first()
    wide = seen["n"] > max_patterns or (seen["bytes"] or 0) > MAX_NAMES
    sources = patterns.select("words", F.explode("__weft_m").alias("s")).groupBy("s").agg(F.sum("words").alias("words"))
    sources = scratch.keep(numbered(scratch.keep(sources, "sizes-of-sources", small=True), "s", stored=True), "sources", small=True)
    # Documents of several sources count once towards the words to share.
    held = sources.agg(F.sum("words")).first()[0] or 0
    quota = targets(sources, weights, max_repeats).withColumn("target", F.col("target") * min(1.0, (seen["words"] or 0) / max(1, held)))
    quota = scratch.keep(quota, "targets", small=True)
    own = quota.select(F.col("s").alias("__weft_s"), F.col("words").alias("source_size"), "target")
    n, given = F.nullif("words", F.lit(0)), F.coalesce("given", F.lit(0))
    plan = patterns.withColumn("__weft_s", F.get("__weft_m", F.lit(0))).join(own, "__weft_s", "left").join(_given(patterns, quota, scratch, max_repeats), "__weft_p", "left")
    plan = plan.select("__weft_p", F.coalesce(F.floor(given / n), F.lit(0)).cast("bigint").alias("__weft_floor"), F.coalesce(given % n, F.lit(0)).alias("__weft_rest"), "source_size", "target", (F.col("rows") * 1000 >= (seen["rows"] or 0)).alias("__weft_hot"))
    plan = scratch.keep(plan, "plan", small=True)  # one row per pattern
    small_join = (lambda df: df) if wide else F.broadcast
    # The cell in which a pattern's rest ends, and the room in it: at most CELLS rows per pattern are looked at.
    running = W.partitionBy("__weft_p").orderBy("__weft_cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = cells.withColumn("__weft_upto", F.sum("words").over(running)).join(small_join(plan.select("__weft_p", "__weft_rest")), "__weft_p")
    ends = ends.filter((F.col("__weft_upto") > F.col("__weft_rest")) & (F.col("__weft_upto") - F.col("words") <= F.col("__weft_rest")))
    ends = ends.groupBy("__weft_p").agg(F.min(F.struct("__weft_cell", (F.col("__weft_rest") - (F.col("__weft_upto") - F.col("words"))).alias("__weft_room"))).alias("__weft_e")).select("__weft_p", "__weft_e.*")
    # Inside that cell different documents in order, each with its number of copies, as long as all of them fit: the last of
    # them is the threshold for the whole pattern. Of the next one as many copies are taken as fit.
    order = W.partitionBy("__weft_p").orderBy("__weft_at").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = small.withColumn("__weft_cell", F.col("__weft_at.__weft_cell")).join(small_join(ends), ["__weft_p", "__weft_cell"])
    last = last.groupBy("__weft_p", "__weft_room", "__weft_at").agg(F.count("*").alias("copies")).withColumn("__weft_upto", F.sum(F.col("copies") * F.col("__weft_at.size")).over(order))
    fits = F.col("__weft_upto") <= F.col("__weft_room")
    last = last.groupBy("__weft_p").agg(
        F.max(F.when(fits, F.col("__weft_at"))).alias("__weft_last"), F.coalesce(F.max(F.when(fits, F.col("__weft_upto"))), F.lit(0)).alias("__weft_used"), F.min(F.when(~fits, F.col("__weft_at"))).alias("__weft_next")
    )
    cut = ends.join(last, "__weft_p", "left").withColumn("__weft_gap", F.col("__weft_room") - F.coalesce("__weft_used", F.lit(0)))
    part = F.coalesce(F.floor(F.col("__weft_gap") / F.col("__weft_next.size")), F.lit(0)).cast("bigint")
    cut = cut.withColumn("__weft_some", part).withColumn("__weft_gap", F.col("__weft_gap") - F.coalesce(F.col("__weft_some") * F.col("__weft_next.size"), F.lit(0)))
    cut = scratch.keep(cut.select("__weft_p", F.col("__weft_cell").alias("__weft_end"), "__weft_last", "__weft_next", "__weft_some", "__weft_gap"), "cut", small=True)  # one row per pattern
    # What is still missing goes to up to SPARES documents of each size, from the largest that fit on.
    hot = plan.select("__weft_p", "__weft_hot")
    left = _planned(small, cut.join(small_join(hot), "__weft_p"), wide).filter(~_before(F.col("__weft_at")) & (F.col("__weft_at.size") > 0) & (F.col("__weft_at.size") <= F.col("__weft_gap")) & ~F.col("__weft_at").eqNullSafe(F.col("__weft_next")))
    left = left.groupBy("__weft_p", "__weft_gap", F.col("__weft_at.size").alias("n"), F.pmod("__weft_at.__weft_h", F.lit(SPARES)).alias("spare")).agg(F.min("__weft_at").alias("at"))
    left = left.groupBy("__weft_p", "__weft_gap").agg(F.reverse(F.array_sort(F.collect_list(F.struct("n", "at")))).alias("sizes"))  # at most SPARES entries for each number of words up to the gap, which is less than a document
    chosen = F.aggregate(
        "sizes",
        F.struct(F.col("__weft_gap").alias("gap"), F.slice(F.transform("sizes", lambda x: x["at"]), 1, 0).alias("picks")),
        lambda s, x: F.when(x["n"] <= s["gap"], F.struct((s["gap"] - x["n"]).alias("gap"), F.concat(s["picks"], F.array(x["at"])).alias("picks"))).otherwise(s),
    )
    cut = cut.join(left.select("__weft_p", chosen["picks"].alias("__weft_picks")), "__weft_p", "left")
    single = F.concat(F.when(F.col("__weft_some") > 0, F.array("__weft_next")).otherwise(F.slice(F.array("__weft_next"), 1, 0)), F.coalesce("__weft_picks", F.slice(F.array("__weft_next"), 1, 0)))
    cut = scratch.keep(cut.withColumn("__weft_single", single).drop("__weft_picks"), "decision", small=True)
    plan = scratch.keep(plan.join(small_join(cut), "__weft_p", "left"), "decided", small=True)
    decided = lambda df: _planned(df, plan, wide)
    # Rows with the hash of a single document are few. Those equal to one are numbered: within their partitions, then over all.
    is_single = F.coalesce(F.array_contains("__weft_single", F.col("__weft_at")), F.lit(False))
    hashed = F.coalesce(F.exists("__weft_single", lambda x: x["__weft_h"] == F.col("__weft_h")), F.lit(False))
    main = sized(decided(placed).filter(~hashed)).withColumn("__weft_extra", _before(F.col("__weft_at")))
    equal = scratch.keep(sized(decided(placed).filter(hashed)).withColumn("__weft_part", F.spark_partition_id()), "equal", small=True)
    of = ["__weft_p", "__weft_at"]
    parts = equal.groupBy(*of, "__weft_part").agg(F.count("*").alias("n")).withColumn("__weft_upto", F.sum("n").over(W.partitionBy(*of).orderBy("__weft_part")) - F.col("n")).drop("n")
    number = F.row_number().over(W.partitionBy(*of, "__weft_part").orderBy("__weft_h")) + F.col("__weft_upto")
    room = F.when(F.col("__weft_at").eqNullSafe(F.col("__weft_next")), F.col("__weft_some")).otherwise(1)
    parts = parts.withColumnsRenamed({c: f"{c}_of" for c in (*of, "__weft_part")})
    same = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in (*of, "__weft_part")]
    equal = equal.join(parts, same).drop(*(f"{c}_of" for c in (*of, "__weft_part"))).withColumn("__weft_extra", F.when(is_single, number <= room).otherwise(_before(F.col("__weft_at"))))
    rows = main.unionByName(equal.drop("__weft_part", "__weft_upto"))
    rows = rows.withColumn("repeats", F.col("__weft_floor") + F.when(F.col("__weft_extra"), 1).otherwise(0))
    rows = rows.withColumn("taken", F.col("repeats") * F.col("size"))
    return rows.drop(*[c for c in rows.columns if c.startswith("__weft_")])


def _before(at: Column) -> Column:
    """Whether a document comes before the threshold of its pattern; where no quota ends, nothing does."""
    return F.coalesce((at["__weft_cell"] < F.col("__weft_end")) | (at <= F.col("__weft_last")), F.lit(False))
