"""Connected components of links, as DataFrames: stars towards ever smaller neighbours, until nothing changes or few links are left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _with_least(links: DataFrame, many: int) -> DataFrame:
    """links (a, b) and m, the smallest b of their a. Nodes of at least ``many`` links, a bounded number of them, are broadcast, so
    that the links of none meet in one task; the others are joined."""
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(least.filter(F.col("n") >= many).select("a", F.col("m").alias("hub")))  # at most links / many rows
    marked = links.join(hubs, "a", "left")
    rest = marked.filter(F.col("hub").isNull()).select("a", "b").join(least.filter(F.col("n") < many).select("a", "m"), "a")
    return rest.unionByName(marked.filter(F.col("hub").isNotNull()).select("a", "b", F.col("hub").alias("m")))


def _to_smallest(links: DataFrame, large: bool, many: int) -> DataFrame:
    """One star step over links (a, b). Large: neighbours above a node move to its smallest neighbour; small: those below."""
    if large:
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moved = _with_least(near, many).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        return moved.filter("a <> b").distinct()
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    moved = _with_least(down, many).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = down.groupBy("a").agg(F.min("b").alias("b"))
    return moved.unionByName(own).filter("a <> b").distinct()


#: Nodes whose links are broadcast: at most twice as many, and none with fewer links than ``FEW``.
HUBS, FEW = 100_000, 200


#: Links that one task settles, 16 MB of them; more are worked on in rounds.
LAST = 1 << 20


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node of each one's component) of links."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # x and y are roots
        while not np.array_equal(up := root[root], root):
            root = up
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[root]


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if taken := list(batches):
        a, b = (np.concatenate([t.column(c).to_numpy() for t in taken]) for c in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in roots(a, b)], names=["node", "root"])


def components(links: DataFrame, scratch: Scratch, label: str, max_rounds: int = 60, last: int = LAST) -> DataFrame:
    """links (a bigint, b bigint) -> (node, root): every linked node and the smallest node of its component.

    Each round is written to the shared folder and read again, so that a lost executor costs one round at most. A node's
    links are reduced to the smallest one before the shuffle and never gathered. At most ``last`` links are settled by one task instead: a round is
    a large plan, which costs the driver more memory than they do.
    """
    now = scratch.keep(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-0", small=True)
    mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    for i in range(1, max_rounds + 1):
        if mark["n"] <= last:
            return scratch.keep(now.select("a", "b").coalesce(1).mapInArrow(_at_once, "node bigint, root bigint"), f"{label}-roots")
        many = max(FEW, mark["n"] // HUBS)
        now = scratch.keep(_to_smallest(_to_smallest(now, True, many), False, many), f"{label}-{i}", small=True)
        scratch.drop(f"{label}-{i - 1}")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = seen
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
