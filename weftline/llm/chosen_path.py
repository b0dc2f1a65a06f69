"""Near-duplicates by chosen paths: documents whose sets of two-word shingles have a Jaccard similarity of at least 80 %.

1. Documents with equal sets are one class. A class has ``COORDS`` minwise values of eight bits; two classes agree in one with the
   chance of their similarity (and 1/256 of the rest).
2. Trees: every node chooses ``BRANCH`` pairs of coordinates by its own hash, and sends each of its classes on to the child for that
   class's two values of each. A node with one class ends; one with up to ``LEAF`` classes compares all its pairs by their values. A pair of
   similarity s stays together in a tree, however deep, with the chance q = 1 - (1 - s * s * q) ** 4 at least: 0.98 at 0.8. ``TREES``
   independent trees leave 0.02 ** 4 = 2e-7 of such pairs apart. Steps of two coordinates keep unlike texts apart from the first one on, up
   to some ten million classes, so that rows grow with the classes; beyond, nodes that are too large take further steps.
3. A node of more classes first looks for pivots, the centres of dense parts of its first ``LEAF`` classes. All its classes are compared
   with them. Similar ones are linked to the pivot as candidates; close ones go no further down, since what is similar to them is linked to
   the pivot itself (distances are metric). So copies of one text cost one link each, and only what is apart branches on.
   Nodes of more than a 4096th of a round's rows, and ``HOT`` at least, do this in all tasks at once with pivots made beforehand,
   instead of in the one task of their key.
4. Candidates are only good for forming groups, the connected components of their links. In a group all sets are compared by their full
   shingles: bitmaps bound the overlap, exact intersections decide; large groups are cut into size-banded tiles.
5. Connected components of the exact links.

Rounds go down all trees at once; each is one shuffle of rows of 90 bytes; what goes on is written to the shared folder. What is left after
``ROUNDS`` is linked as candidates without further tests, so nothing falls out. Tests count the recall of the candidates.

Nulls and odd input: a null, empty or blank text has no shingles, is linked with nothing and is its own component; a text of one
word is one shingle; repeated rows are copies, and each of them is kept if its id is the smallest; an empty table gives an empty
result; a null document id belongs to its class, whose smallest id is not null if any is, and is kept if none is; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard_join as J
from . import kernels as K
from .common import Scratch, bounded_batches
from .components import components

SHINGLE = 2
#: Similarity as a fraction of whole numbers: 80 %.
RATIO = (4, 5)
COORDS, TREES, BRANCH, LEAF, PIVOTS, ROUNDS = 64, 4, 4, 256, 32, 14
#: Agreeing values, of 64. Similar pairs have 51 on average, 3.2 more or less: 36 and more in a leaf. In larger nodes: linked with a
#: pivot from 16 on, and ended by it from 40 on, for which 24 values may differ between the ended class and one similar to it.
NEAR, LINKED, ENDED = 36, 16, 40
HOT = 20_000
U = np.uint64
_MASK = (1 << 64) - 1
_TIMES = np.array([(0xD6E8FEB86659FD93 * (2 * i + 1) ^ (i << 33)) & _MASK | 1 for i in range(COORDS)], U)
_PLUS = K.mix64(np.arange(1, COORDS + 1, dtype=U) * U(0xA0761D6478BD642F))
_MEMBERS = "node bigint, cid bigint, sig binary"


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise values of sets that are not empty, one row each."""
    size = np.array([len(s) for s in sets])
    flat, start = np.concatenate(sets), np.cumsum(size) - size
    out = np.empty((len(sets), COORDS), np.uint8)
    for j in range(COORDS):
        least = np.minimum.reduceat((flat ^ _PLUS[j]) * _TIMES[j], start)
        out[:, j] = (K.mix64(least) >> U(56)).astype(np.uint8)
    return out


def classify(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n, cid, check, sig); a class has its signature in its first row of each block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, sets in J._blocks(batches, 1, SHINGLE):
            keys = [J.class_key(s) if len(s) else (0, 0) for s in sets]
            first: dict[tuple[int, int], int] = {}
            for i, s in enumerate(sets):
                if len(s):
                    first.setdefault(keys[i], i)
            sigs: list[bytes | None] = [None] * len(sets)
            if first:
                for i, sig in zip(first.values(), signatures([sets[i] for i in first.values()]), strict=True):
                    sigs[i] = sig.tobytes()
            cid, check = (pa.array([k[x] for k in keys], pa.int64()) for x in (0, 1))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array([len(s) for s in sets], pa.int64()), cid, check, pa.array(sigs, pa.binary())], names=["doc_id", "n", "cid", "check", "sig"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(scan, "doc_id bigint, n bigint, cid bigint, check bigint, sig binary")


def children(node: np.ndarray, sig: np.ndarray) -> list[np.ndarray]:
    """The next nodes of rows: one array for each chosen pair of coordinates."""
    out, row = [], np.arange(len(node))
    for b in range(BRANCH):
        chosen = K.mix64(node ^ U(0x9E3779B97F4A7C15 * (b + 1) & _MASK))
        one = (chosen % U(COORDS)).astype(np.int64)
        two = (one + 1 + ((chosen >> U(32)) % U(COORDS - 1)).astype(np.int64)) % COORDS
        value = (((b * COORDS + one) * COORDS + two) << 16 | sig[row, one].astype(np.int64) << 8 | sig[row, two]).astype(U)
        out.append(K.mix64(K.mix64(node) + K.mix64(value + U(1))))
    return out


def _sig(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDS)


def _members(node: np.ndarray, cid: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
    raw = np.ascontiguousarray(sig)
    blobs = pa.Array.from_buffers(pa.binary(), len(cid), [None, pa.py_buffer((np.arange(len(cid) + 1) * COORDS).astype(np.int32)), pa.py_buffer(raw)])
    return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(cid), blobs], names=["node", "cid", "sig"])


def roots(classes: DataFrame) -> DataFrame:
    """classes (cid, sig) -> (node, cid, sig): their nodes one step below the root of every tree."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cid, sig = batch.column(0).to_numpy(), _sig(batch.column(1))
                for tree in range(TREES):
                    for node in children(np.full(len(cid), tree + 1, U), sig):
                        yield _members(node, cid, sig)

    return classes.select("cid", "sig").mapInArrow(plant, _MEMBERS)


def agreements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)), np.uint8)
    for j in range(COORDS):
        out += a[:, j, None] == b[None, :, j]
    return out


def pivots_of(sig: np.ndarray) -> np.ndarray:
    """Rows with the most others close to them, one for each dense part."""
    close = agreements(sig, sig) >= ENDED
    out = []
    while len(out) < PIVOTS:
        n = close.sum(1)
        best = int(n.argmax())
        if n[best] < 2:
            break
        out.append(best)
        gone = close[best].copy()
        close[gone] = False
        close[:, gone] = False
    return np.array(out, np.int64)


class Links:
    """Candidate links and rows that go on, as they come."""

    def __init__(self) -> None:
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.on: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def large(self, node: np.ndarray, cid: np.ndarray, sig: np.ndarray, pivot: np.ndarray, pivot_sig: np.ndarray) -> None:
        """Rows of a node that is too large to compare all pairs."""
        for i in range(0, len(cid), 8192):
            n, c, s = node[i : i + 8192], cid[i : i + 8192], sig[i : i + 8192]
            if len(pivot):
                agree = agreements(s, pivot_sig)
                row, at = np.nonzero(agree >= LINKED)
                self.links.append((c[row], pivot[at]))
                left = agree.max(1) < ENDED
                n, c, s = n[left], c[left], s[left]
            for child in children(n, s):
                self.on.append((child, c, s))

    def leaf(self, cid: np.ndarray, sig: np.ndarray) -> None:
        near = agreements(sig, sig) >= NEAR
        left = np.ones(len(cid), bool)
        for seed in range(len(cid)):
            if left[seed]:
                reach = np.zeros(len(cid), bool)
                grown = near[seed] & left
                while grown.any():
                    reach |= grown
                    grown = near[grown].any(0) & left & ~reach
                left &= ~reach
                reach[seed] = False
                other = cid[reach]
                self.links.append((other, np.full(len(other), cid[seed])))

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.links:
            a, b = (np.concatenate(x) for x in zip(*self.links, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int32)), pa.array(a), pa.array(b), pa.nulls(len(a), pa.binary())], names=["kind", "node", "cid", "sig"])
        for part in self.on:
            rows = _members(*part)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(rows), np.int32)), *rows.columns], names=["kind", "node", "cid", "sig"])
        self.links, self.on = [], []


_STEP = "kind int, node bigint, cid bigint, sig binary"


def _walk(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their nodes: leaves are compared, nodes of more than ``most`` meet their pivots and branch. Holds at most a batch and ``most`` rows."""
    out = Links()
    held = (np.zeros(0, U), np.zeros(0, np.int64), np.zeros((0, COORDS), np.uint8))
    open_node, pivot, pivot_sig = None, held[1], held[2]

    def settle(node: np.ndarray, cid: np.ndarray, sig: np.ndarray) -> None:
        starts, sizes = J._runs(node)
        few = min(8, most)
        short = np.repeat(sizes, sizes) <= few
        for gap in range(1, 8):
            if len(node) <= gap:
                break
            at = np.flatnonzero((node[gap:] == node[:-gap]) & short[gap:])
            at = at[(sig[at] == sig[at + gap]).sum(1) >= NEAR]
            if len(at):
                out.links.append((cid[at + gap], cid[at]))
        for s, n in zip(starts[sizes > few], sizes[sizes > few], strict=True):
            part = slice(s, s + n)
            if n <= most:
                out.leaf(cid[part], sig[part])
            else:
                best = pivots_of(sig[s : s + most])
                out.large(node[part], cid[part], sig[part], cid[part][best], sig[part][best])

    for batch in batches:
        if not len(batch):
            continue
        rows = (batch.column(0).to_numpy().view(U), batch.column(1).to_numpy(), _sig(batch.column(2)))
        rows = tuple(np.concatenate([h, r]) for h, r in zip(held, rows, strict=True))
        if open_node is not None:
            n = int(np.argmax(rows[0] != open_node)) if (rows[0] != open_node).any() else len(rows[0])
            out.large(*(r[:n] for r in rows), pivot, pivot_sig)
            rows = tuple(r[n:] for r in rows)
            if len(rows[0]):
                open_node = None
        if len(rows[0]):
            last = int(np.argmax(rows[0] == rows[0][-1]))
            settle(*(r[:last] for r in rows))
            held = tuple(r[last:] for r in rows)
            if len(held[0]) > most:
                open_node = held[0][0]
                best = pivots_of(held[2][:most])
                pivot, pivot_sig = held[1][best], held[2][best]
                out.large(*held, pivot, pivot_sig)
                held = tuple(h[:0] for h in held)
        else:
            held = tuple(h[:0] for h in held)
        yield from out.batches()
    if len(held[0]):
        settle(*held)
    yield from out.batches()


def candidate_links(classes: DataFrame, scratch: Scratch, leaf: int = LEAF, hot: int = HOT, rounds: int = ROUNDS) -> DataFrame:
    """classes (cid, sig) -> (a, b): links whose components hold together all similar pairs, but for what all trees miss."""
    spark = classes.sparkSession
    walk = lambda batches: _walk(batches, leaf)
    now, n = roots(classes), classes.count() * TREES * BRANCH
    links = []
    for i in range(1, rounds + 1):
        if not n:
            break
        # Hot nodes are seen in a 64th of the classes; where the estimate errs, the other way gives the same links.
        many = max(hot, n // 4096)
        share = 64 if many >= 64 * 64 else 1
        seen = roots(classes.filter(F.pmod(F.xxhash64("cid"), F.lit(share)) == 0)) if i == 1 else now.filter(F.pmod(F.xxhash64("cid"), F.lit(share)) == 0)
        sample = seen.groupBy("node").count().filter(F.col("count") >= many // share)
        at = {r["node"]: r["count"] for r in sample.collect()}  # at most some 4096 nodes
        if at:
            few = F.broadcast(spark.createDataFrame([(k, max(1, c * share // LEAF)) for k, c in at.items()], "node bigint, part bigint"))
            some = now.join(few, "node").filter(F.pmod(F.xxhash64("cid", "node"), F.col("part")) == 0).select("node", "cid", "sig")
            chosen = some.groupBy("node").applyInArrow(_choose, _MEMBERS).toArrow()  # at most PIVOTS for a hot node
            held: dict[int, tuple[np.ndarray, np.ndarray]] = {k: (np.zeros(0, np.int64), np.zeros((0, COORDS), np.uint8)) for k in at}
            keys, cids, sigs = chosen.column("node").to_numpy(), chosen.column("cid").to_numpy(), _sig(chosen.column("sig"))
            for k in np.unique(keys):
                held[int(k)] = cids[keys == k], sigs[keys == k]
            shared = spark.sparkContext.broadcast(held)

            def hot_step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                out = Links()
                for batch in batches:
                    node, cid, sig = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _sig(batch.column(2))
                    for k in np.unique(node):
                        own = node == k
                        out.large(node[own].view(U), cid[own], sig[own], *shared.value[int(k)])
                    yield from out.batches()

            rest = now.join(few, "node", "left_anti")
            step = now.join(few, "node", "left_semi").mapInArrow(hot_step, _STEP).unionByName(_by_node(rest).mapInArrow(walk, _STEP))
        else:
            step = _by_node(now).mapInArrow(walk, _STEP)
        step = scratch.keep(step, f"round-{i}", ("kind",))
        links.append(step.filter("kind = 0").select(F.col("node").alias("a"), F.col("cid").alias("b")))
        now = step.filter("kind = 1").select("node", "cid", "sig")
        n = now.count()
    else:
        least = now.groupBy("node").agg(F.min("cid").alias("b"), F.max("cid").alias("top")).filter("top > b")
        links.append(now.join(least, "node").select(F.col("cid").alias("a"), "b"))
    out = links[0] if links else spark.createDataFrame([], "a bigint, b bigint")
    for more in links[1:]:
        out = out.unionByName(more)
    return out.filter("a <> b").distinct()


def _by_node(rows: DataFrame) -> DataFrame:
    return rows.repartition("node").sortWithinPartitions("node", "cid")


def _choose(table: pa.Table) -> pa.Table:
    """Pivots of a hot node from some LEAF of its rows."""
    table = table.slice(0, 2 * LEAF)
    return table.take(pa.array(pivots_of(_sig(table.column("sig").combine_chunks()))))


def near_classes(docs: DataFrame, tile: int = J.TILE, pack_words: int = 400_000, leaf: int = LEAF, hot: int = HOT, rounds: int = ROUNDS) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_shingles, component_id, kept), one row per document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "paths")
    docs = docs.select("doc_id", "text")
    classes, twice, _ = J.tell_apart(scratch.keep(classify(docs), "scan"))
    one = scratch.keep(classes.filter(F.col("sig").isNotNull()).groupBy("cid").agg(F.first("sig").alias("sig")), "classes")
    candidates = candidate_links(one, scratch, leaf, hot, rounds)
    groups = components(candidates, scratch, "groups").withColumnRenamed("node", "cid")
    sets = J.class_sets(docs, groups.select("cid"), twice, k=SHINGLE).join(groups, "cid")
    links = scratch.keep(J.meet(sets, scratch, "sets", tile, pack_words, ratio=RATIO), "links", small=True)
    scratch.drop("sets")
    out = J.by_document(classes.drop("sig"), links, scratch)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
