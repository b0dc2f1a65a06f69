"""A trie of conversations' common beginnings, with counts, leaves and savings for every node.

1. Turns are numbered within their conversation by ranges, so that a conversation of any number of turns is dealt over tasks.
2. A prefix digest is 128 bits: two sums by exclusive or over a hash of each turn's place and digest. It is summed within chunks
   of ``CHUNK`` turns and then over chunks, again without bringing a conversation together.
3. Rows (conversation, depth, prefix digest, digest of the prefix before) are dealt to shards by their first turn, and a first turn with
   too many rows by conversation as well: a shard holds whole chunks of paths, so it has the parents of all of its nodes. Nodes that
   several shards have are matched by digest; one of the shards owns them. A digest is verified: all its rows must have the same
   parent and the same last turn by SHA-256, from which equal sequences follow by induction.
4. In a shard the distinct digests get the slots of a minimal perfect hash table, each slot checked against its full digest. Members,
   first members and own savings are scattered into flat arrays, and, deepest nodes first, added to the parent's slot. What shards find for
   a node adds up, since every node counts in the shard that owns it alone, and that shard has the whole path above it, or the part of
   it in its chunk; later chunks hand their sums up by conversation.
5. Ids of the conversations that end in a node are sorted by ranges, written as pieces of text and hashed piece by piece, so that no
   row holds them all. The hash itself is sequential: one task reads a node's pieces.

Nulls and odd input: a null turn stands first, null roles and texts are empty; turns of one place are ordered by role, then by the digest
of role and text; repeated rows are turns of their own; rows without a conversation id take no part; negative ids
belong to the group of the id minus its remainder, which has their sign; a conversation that loses all its turns ends in the root;
an empty table has no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import kernels as K
from .common import Scratch, bounded_batches, literal_rows

#: Turns of a path in one piece, rows of a shard, bytes of ids in one piece of text.
CHUNK, SHARD, PIECE = 1 << 16, 100_000, 1 << 18
U = np.uint64


def numbered_turns(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (conv_id, turn, role, text) -> (conv_id, pos, t, bytes): places from 0, SHA-256 digests of role and text, bytes of the text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    rows = rows.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), digest.alias("t"), F.octet_length(text).cast("bigint").alias("bytes"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "t", "__id"]
    rows = rows.withColumn("__id", F.monotonically_increasing_id())  # equal rows, however many, can be dealt to several ranges
    place = F.monotonically_increasing_id()
    kept = rows.orderBy(*order).select("conv_id", "t", "bytes", F.shiftright(place, 33).alias("range"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    kept = scratch.keep(kept, "turns")
    # Where a conversation begins in each range, and how much of it earlier ranges have: more than nothing once a range at most.
    parts = scratch.keep(kept.groupBy("conv_id", "range").agg(F.min("at").alias("from"), F.count("*").alias("n")), "parts", small=True)
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("conv_id", "range", (before - F.col("from")).alias("shift"))
    return kept.join(starts, ["conv_id", "range"]).select("conv_id", (F.col("at") + F.col("shift")).alias("pos"), "t", "bytes")


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Numbered turns -> ((c, n, d, t, bytes), (c, n)): conversation c begins with the first h turns of conversation c - c % group, h its
    crc32 % most, and goes on with its own after the first h; d from 1; n turns."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("size"))
    one = sizes.select("conv_id", "size", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    one = one.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_size", F.lit(0))))
    one = one.withColumn("n", F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0)))
    ends = one.select(F.col("conv_id").alias("c"), "n")
    first = turns.filter((F.col("conv_id") % group == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv_id", "base")
    first = one.select(F.col("conv_id").alias("c"), "base", "h", "n").join(first, "base").filter("pos < h").select("c", "n", (F.col("pos") + 1).alias("d"), "t", "bytes")
    # A conversation meets its row once for each chunk of it, so that a very long one is spread.
    spread = one.select("conv_id", "h", "taken", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("size") / chunk))).alias("part"))
    own = turns.withColumn("part", F.floor(F.col("pos") / chunk)).join(spread, ["conv_id", "part"]).filter("pos >= h")
    own = own.select(F.col("conv_id").alias("c"), "n", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("d"), "t", "bytes")
    return first.unionByName(own), ends


def paths(turns: DataFrame, scratch: Scratch, chunk: int = CHUNK) -> DataFrame:
    """(c, n, d, t, bytes) -> the same with chunk, prefix digest (k1, k2), that of the prefix before (p1, p2), and the first turn's digest of the
    chunk, top. The last turn of a chunk stands before the next one again, as its head."""
    hashed = lambda seed: F.xxhash64(F.lit(seed), "d", "t")
    rows = turns.select("c", "n", "d", "t", "bytes", F.floor((F.col("d") - 1) / chunk).alias("chunk"), hashed(1).alias("g1"), hashed(2).alias("g2"))
    order = W.partitionBy("c", "chunk").orderBy("d")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("c", "n", "d", "t", "bytes", "chunk", "g1", "g2", F.bit_xor("g1").over(so_far).alias("k1"), F.bit_xor("g2").over(so_far).alias("k2"))
    rows = scratch.keep(rows, "local")
    sums = rows.filter(F.col("d") % chunk == 0).select("c", (F.col("chunk") + 1).alias("chunk"), "k1", "k2")  # one row for each full chunk
    before = W.partitionBy("c").orderBy("chunk").rowsBetween(W.unboundedPreceding, 0)
    offsets = sums.select("c", "chunk", F.bit_xor("k1").over(before).alias("o1"), F.bit_xor("k2").over(before).alias("o2"))
    none = F.lit(0).cast("bigint")
    rows = rows.join(offsets, ["c", "chunk"], "left").withColumns({"o1": F.coalesce("o1", none), "o2": F.coalesce("o2", none)})
    rows = rows.select("c", "n", "chunk", "d", "t", "bytes", (F.col("k1").bitwiseXOR(F.col("o1"))).alias("k1"), (F.col("k2").bitwiseXOR(F.col("o2"))).alias("k2"), "g1", "g2")
    rows = rows.withColumns({"p1": F.col("k1").bitwiseXOR(F.col("g1")), "p2": F.col("k2").bitwiseXOR(F.col("g2"))}).drop("g1", "g2")
    heads = rows.filter((F.col("d") % chunk == 0) & (F.col("d") < F.col("n"))).withColumn("chunk", F.col("chunk") + 1)
    rows = rows.withColumn("head", F.lit(False)).unionByName(heads.withColumn("head", F.lit(True)))
    return scratch.keep(rows.withColumn("top", F.first("k1").over(order)), "paths")


def shards(rows: DataFrame, per_shard: int = SHARD) -> DataFrame:
    """Path rows with the shard of their chunk. A top with more rows than a shard holds is dealt out by conversation."""
    n = max(1, -(-rows.count() // per_shard))
    hot = rows.groupBy("top").agg(F.count("*").alias("k")).filter(F.col("k") > per_shard).select("top", F.ceil(F.col("k") / per_shard).alias("pieces"))
    rows = rows.join(F.broadcast(hot), "top", "left")  # at most one row for each shard
    piece = F.pmod(F.xxhash64("c", "chunk"), F.coalesce(F.col("pieces"), F.lit(1)))
    return rows.withColumn("shard", F.pmod(F.xxhash64("top", piece), F.lit(n))).drop("top", "pieces")


class SlotTable:
    """A minimal perfect hash table of distinct 128-bit digests: levels of bits, in which a digest stays that is alone in its place;
    a slot is the number of bits before. Every look-up compares the whole digest."""

    def __init__(self, k1: np.ndarray, k2: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = len(k1)
        self.k1, self.k2 = np.empty(self.n, U), np.empty(self.n, U)
        left, base = np.arange(self.n), 0
        while len(left):
            size = max(64, 2 * len(left))
            at = self._place(k1[left], k2[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            rank = np.cumsum(alone) - alone + base
            self.levels.append((alone, rank))
            settled = alone[at]
            slot = rank[at[settled]]
            self.k1[slot], self.k2[slot] = k1[left[settled]], k2[left[settled]]
            left, base = left[~settled], base + int(alone.sum())

    @staticmethod
    def _place(k1: np.ndarray, k2: np.ndarray, level: int, size: int) -> np.ndarray:
        return (K.mix64(k1 ^ K.mix64(k2 + U(level))) % U(size)).astype(np.int64)

    def slots(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Slots of digests, -1 for those that the table does not hold."""
        out, left = np.full(len(k1), -1, np.int64), np.arange(len(k1))
        for i, (alone, rank) in enumerate(self.levels):
            at = self._place(k1[left], k2[left], i, len(alone))
            here = alone[at]
            out[left[here]] = rank[at[here]]
            left = left[~here]
        found = out >= 0
        found[found] = (self.k1[out[found]] == k1[found]) & (self.k2[out[found]] == k2[found])
        return np.where(found, out, -1)


_NODE = "k1 bigint, k2 bigint, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"


def accumulate(table: pa.Table) -> pa.Table:
    """The nodes of a shard with the sums of what it owns below them. Columns of a node's own are set where the shard owns it."""
    column = lambda c: table.column(c).to_numpy()
    k1, k2, p1, p2 = (column(c).view(U) for c in ("k1", "k2", "p1", "p2"))
    # The head of a chunk is a node of its own beside the same node as the end of the chunk before.
    head, mark = column("head"), K.mix64(np.ones(1, U))
    k2, p2 = np.where(head, k2 ^ mark, k2), np.where(column("cut"), p2 ^ mark, p2)
    nodes = SlotTable(k1, k2)
    n = nodes.n
    slot = nodes.slots(k1, k2)
    depth, parent, conv, convs, own, top = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)
    depth[slot], conv[slot], convs[slot], own[slot], top[slot] = column("d"), column("conv_id"), column("n_convs"), column("own"), head
    parent[slot] = np.where(head, -1, nodes.slots(p1, p2))
    leaves, saved, children = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    leaves[slot] = column("own") & ~column("more")
    saved[slot] = np.where(column("own"), (column("n_convs") - 1) * column("bytes"), 0)
    # Sums of later chunks come in at the chunk's last node.
    leaves[slot] += column("carried_leaves")
    saved[slot] += column("carried_saved")
    up = own & (parent >= 0)
    np.add.at(children, parent[up], 1)
    deepest = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[deepest])) + 1
    for level in np.split(deepest, cuts):
        level = level[parent[level] >= 0]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    # A head's sums are not its own: its children's are handed up by conversation.
    leaves[top], saved[top] = 0, 0
    above = np.where(parent >= 0, conv[np.maximum(parent, 0)], 0)
    opt = lambda x, ok: pa.array(x, pa.int64(), mask=~ok)
    return pa.table({
        "k1": pa.array(nodes.k1.view(np.int64)), "k2": pa.array(np.where(top, nodes.k2 ^ mark, nodes.k2).view(np.int64)), "depth": pa.array(depth), "conv_id": opt(conv, own), "parent_conv_id": opt(above, own & (parent >= 0)),
        "n_convs": opt(convs, own), "n_children": pa.array(children), "n_leaves": pa.array(leaves), "saved_tokens": pa.array(saved),
    })


def trie_nodes(rows: DataFrame, scratch: Scratch, chunk: int = CHUNK) -> DataFrame:
    """Path rows with their shard, and whether a conversation goes on (more) -> the nodes below the root."""
    shared = rows.groupBy("shard", "k1", "k2", "head").agg(
        F.min("c").alias("least"), F.count("*").alias("n"), F.max("more").alias("more"), F.first("d").alias("d"), F.first("bytes").alias("bytes"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("t").alias("t"), F.max("p1").alias("q1"), F.max("p2").alias("q2"), F.max("t").alias("u"),
    )
    node = W.partitionBy("k1", "k2")  # one row for each shard that has the node
    counted = ~F.col("head")
    each = lambda f, x: f(F.when(counted, x)).over(node)
    shared = shared.select(
        "shard", "k1", "k2", "p1", "p2", "d", "bytes", "head",
        F.min("least").over(node).alias("conv_id"), F.coalesce(each(F.sum, F.col("n")), F.lit(0)).alias("n_convs"), F.max("more").over(node).alias("more"),
        (counted & (F.col("shard") == each(F.min, F.col("shard")))).alias("own"),
        ((F.min("p1").over(node) == F.max("q1").over(node)) & (F.min("p2").over(node) == F.max("q2").over(node)) & (F.min("t").over(node) == F.max("u").over(node))).alias("same"),
    )
    shared = scratch.keep(shared, "nodes")
    if not shared.filter(~F.col("same")).isEmpty():
        raise RuntimeError("two prefixes share a digest of 128 bits; other seeds of the hashes in paths() are needed")
    # Paths of several chunks: what a conversation owns in later ones goes to the last node of each earlier chunk.
    owned = shared.filter("own").withColumn("chunk", F.floor((F.col("d") - 1) / chunk))
    later = owned.filter("chunk > 0").groupBy("conv_id", "chunk").agg(F.sum((~F.col("more")).cast("bigint")).alias("leaves"), F.sum((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    heads = rows.filter("head").select(F.col("c").alias("conv_id"), "chunk", "k1", "k2")
    after = W.partitionBy("conv_id").orderBy(F.desc("chunk")).rowsBetween(W.unboundedPreceding, 0)
    carried = heads.join(later, ["conv_id", "chunk"], "left").select("k1", "k2", F.sum(F.coalesce("leaves", F.lit(0))).over(after).alias("leaves"), F.sum(F.coalesce("saved", F.lit(0))).over(after).alias("saved"))
    carried = carried.groupBy("k1", "k2").agg(F.sum("leaves").alias("carried_leaves"), F.sum("saved").alias("carried_saved")).withColumn("own", F.lit(True))
    whole = shared.join(carried, ["k1", "k2", "own"], "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("carried_leaves", "carried_saved")})
    whole = whole.withColumn("cut", ~F.col("head") & (F.col("d") > 1) & ((F.col("d") - 1) % chunk == 0))
    found = whole.groupBy("shard").applyInArrow(accumulate, _NODE)
    total = {c: F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")}
    return found.groupBy("k1", "k2").agg(F.max("depth").alias("depth"), *(F.max(c).alias(c) for c in ("conv_id", "parent_conv_id", "n_convs")), *total.values())


def end_digests(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """(k1, k2, c) -> (k1, k2, ends_sha256): the ids in numeric order, with commas."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, size = None, [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["k1", "k2", "c", "ids"])

        for batch in batches:
            k1, k2, c = (batch.column(i).to_numpy() for i in range(3))
            new = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
            for a, b in zip([0, *new], [*new, len(c)], strict=True):
                if a == b:
                    continue
                key = (int(k1[a]), int(k2[a]))
                for i in range(a, b, piece // 16):
                    if now is not None and (key != now or size > piece):
                        yield row()
                        ids, size = [], 0
                    now = key
                    ids += c[i : min(b, i + piece // 16)].tolist()
                    size = 8 * len(ids)
        if ids:
            yield row()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, out = None, None, []
        for batch in batches:
            for k1, k2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if (k1, k2) != now:
                    if now is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield _digests(out)
            out = []
        if now is not None:
            yield _digests([(*now, sha.hexdigest())])

    pieces = ends.select("k1", "k2", "c").orderBy("k1", "k2", "c").mapInArrow(join, "k1 bigint, k2 bigint, c bigint, ids string")
    return pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "c").mapInArrow(digest, "k1 bigint, k2 bigint, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["k1", "k2", "ends_sha256"])


def build(rows: DataFrame, chunk: int = CHUNK, per_shard: int = SHARD, piece: int = PIECE) -> DataFrame:
    """rows (conv_id, turn, role, text) -> one row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    bounded_batches(rows.sparkSession)
    scratch = Scratch(rows.sparkSession, "trie")
    turns = numbered_turns(rows, scratch)
    new, ends = rebuilt(turns, chunk=chunk)
    ends = scratch.keep(ends, "ends", small=True)
    path_rows = paths(new, scratch, chunk)
    path_rows = scratch.keep(shards(path_rows.withColumn("more", F.col("d") < F.col("n")).drop("n"), per_shard), "sharded")
    nodes = scratch.keep(trie_nodes(path_rows, scratch, chunk), "found")
    zero = F.lit(0).cast("bigint")
    at_end = path_rows.filter(~F.col("more") & ~F.col("head")).select("k1", "k2", "c").unionByName(ends.filter("n = 0").select(zero.alias("k1"), zero.alias("k2"), "c"))
    digests = end_digests(at_end, piece)
    here = ends.agg(F.min("c").alias("conv_id"), F.count("*").alias("n")).first()
    top = nodes.filter("depth = 1").agg(F.count("*").alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).first()
    root = literal_rows(rows.sparkSession, [(0, 0, 0, here["conv_id"], None, here["n"], top["n"], top["leaves"] or 1, top["saved"] or 0)], _NODE)
    below = nodes.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(here["conv_id"])).otherwise(F.col("parent_conv_id")))
    whole = root.filter("n_convs > 0").unionByName(below).join(digests, ["k1", "k2"], "left")
    none: Column = F.lit(hashlib.sha256(b"").hexdigest())
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
