"""Hard negatives by exact inner products: length buckets with sorted coordinate lists.

1. Components are scaled to whole numbers. Rows are sorted by length, longest first, and cut into blocks: a block is a length
   bucket, at most ``block_rows`` rows, with the order of its rows by every coordinate of their directions.
2. Anchors are taken in passes of at most ``ANCHOR_BYTES``, so that a pass can be broadcast whatever the number of anchors. In a
   block an anchor needs rows whose cosine reaches threshold / (anchor's length * longest row). If that is above 1, the bucket
   is left out. Else each focus coordinate (the anchor's largest) bounds the rows' values to an interval; the interval is a
   slice of the coordinate's list, and only rows in all slices are multiplied out, exactly.
3. A first run over one block gives thresholds, each the k-th score that an anchor has already; they rise while a task runs.
   Where the slices would hold most of a bucket, its rows are multiplied out at once instead.
4. Every task sends at most k rows for each thing wanted: first the positives of an anchor, then, for each positive, the negatives within
   its interval of scores. Windows over (anchor, positive) choose the first k.

Bounds are widened by a millionth, scores are exact: by float64 below 2 ** 53, else by integers. Work is anchors times rows where
nothing can be pruned, as in random directions; memory is a block and a pass.

Nulls and odd input: rows with a null label, a null vector, or a null or non-finite component take no part; a null ``vec_id`` is no
anchor and stands last among ties; vectors of different lengths are filled up with zeros; rows that are equal in id, label and
scaled vector count once; rows that share the anchor's id are never its positives; scaled components and
scores beyond 64 bits are cut to the last such number; an anchor without positives, or a
positive without negatives, has no row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, bounded_batches

SCALE = 256
FOCUS = 3
#: Bytes of the anchors of a pass, and of the scaled vectors of a block.
ANCHOR_BYTES, BLOCK_BYTES = 4 << 20, 2 << 20
#: Above this part of a bucket in the shortest slice, the bucket is multiplied out at once.
DENSE = 0.3
LAST = np.iinfo(np.int64).max


def scaled(rows: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """rows (vec_id, label, vector) -> (vec_id, label, v), v whole numbers, without the rows that take no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return rows.filter(F.col("label").isNotNull() & F.col(vector).isNotNull() & ~bad).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), v.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix, filled up with zeros."""
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _lengths(v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(v.astype(np.float64)).sum(1))


_BLOCK = "n int, ids binary, known binary, labels binary, v binary, lists binary"


def length_blocks(rows: DataFrame, width: int, block_rows: int, parts: int) -> DataFrame:
    """(vec_id, label, v) -> length buckets: ids, labels, vectors and, by coordinate, the order of rows by their directions."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count, before = 0, None

        def block() -> pa.RecordBatch:
            ids, known, labels, v = (np.concatenate(x) for x in zip(*held, strict=True))
            size = _lengths(v)
            lists = np.argsort(v / np.where(size > 0, size, 1)[:, None], axis=0, kind="stable").astype(np.uint16)
            small = v.astype(np.int32) if np.abs(v.astype(np.float64)).max(initial=0) < 2**31 else v
            cells = [len(ids), ids.tobytes(), known.tobytes(), labels.tobytes(), small.tobytes(), lists.T.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([cells[0]], pa.int32()), *(pa.array([c], pa.binary()) for c in cells[1:])], names=["n", "ids", "known", "labels", "v", "lists"])

        for batch in batches:
            if not len(batch):
                continue
            known = np.asarray(batch.column(0).is_valid())
            ids = batch.column(0).fill_null(LAST).to_numpy()
            labels, v = batch.column(1).to_numpy(), _matrix(batch.column(2), width)
            whole = np.column_stack([ids, known, labels, v])
            last = whole[:1] - 1 if before is None else before  # equal rows follow each other
            new = (whole != np.concatenate([last, whole[:-1]])).any(1)
            before = whole[-1:]
            ids, known, labels, v = ids[new], known[new], labels[new], v[new]
            at = 0
            while at < len(ids):
                end = min(len(ids), at + block_rows - count)
                held.append((ids[at:end], known[at:end], labels[at:end], v[at:end]))
                count, at = count + end - at, end
                if count == block_rows:
                    yield block()
                    held, count = [], 0
        if count:
            yield block()

    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    spread = rows.withColumn("__length", length).withColumn("__h", F.xxhash64("vec_id"))
    spread = spread.repartitionByRange(parts, F.desc("__length"), "__h", "vec_id").sortWithinPartitions(F.desc("__length"), "__h", "vec_id", "label", "v")
    return spread.select("vec_id", "label", "v").mapInArrow(build, _BLOCK)


@dataclass
class Wanted:
    """What a pass looks for. Anchors: ids, labels, vectors. Each want is of an anchor, has an interval of scores, and looks among
    rows of the anchor's label or among the others. ``low``: scores that are enough for pruning; -inf if unknown."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    same: bool
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return np.clip(a.astype(object) @ b.astype(object).T, -LAST, LAST).astype(np.int64)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, smaller ids first among equals."""
    if len(scores) > 8 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _candidates(hat: np.ndarray, lists: np.ndarray, q: np.ndarray, bound: float) -> np.ndarray | None:
    """Rows of a bucket whose cosine with the direction q can reach the bound; None if they are too many to be told one by one."""
    n, focus = len(hat), np.argsort(-np.abs(q), kind="stable")[:FOCUS]
    reach = np.sqrt(np.maximum(0.0, (1 - q[focus] ** 2) * (1 - bound**2))) + 1e-6
    slices = []
    for f, r in zip(focus, reach, strict=True):
        # Directions within the angle of the bound around q; the interval is open on the side where the axis itself lies within it.
        values = hat[lists[f], f]
        start = 0 if q[f] <= -bound else np.searchsorted(values, q[f] * bound - r)
        slices.append((f, start, n if q[f] >= bound else np.searchsorted(values, q[f] * bound + r, "right")))
    if min((b - a for _, a, b in slices), default=n) > DENSE * n:
        return None
    seen = np.zeros(n, np.uint8)
    for f, a, b in slices:
        seen[lists[f, a:b]] += 1
    return np.flatnonzero(seen == len(slices))


class Finder:
    """The first k rows of every want, over the blocks that a task reads."""

    def __init__(self, wanted: Wanted, k: int):
        self.w, self.k = wanted, k
        self.size = _lengths(wanted.v)
        self.q = wanted.v / np.where(self.size > 0, self.size, 1)[:, None]
        self.of: list[list[int]] = [[] for _ in wanted.ids]
        for i, a in enumerate(wanted.anchor):
            self.of[a].append(i)
        self.low = np.full(len(wanted.ids), np.inf)  # an anchor's threshold: the lowest of its wants; inf if it wants nothing
        np.minimum.at(self.low, wanted.anchor, wanted.low.astype(np.float64))
        self.need = np.nextafter(wanted.low.astype(np.float64), -np.inf)
        self.found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def block(self, ids: np.ndarray, known: np.ndarray, labels: np.ndarray, v: np.ndarray, lists: np.ndarray) -> None:
        size = _lengths(v)
        hat = v / np.where(size > 0, size, 1)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            bound = self.low / (self.size * size.max(initial=0)) * (1 - 1e-6)
        dense = []
        for a in np.flatnonzero(np.isfinite(self.low) | (self.low < 0)):
            if self.low[a] > 0 and not bound[a] <= 1:
                continue
            rows = _candidates(hat, lists, self.q[a], bound[a]) if self.low[a] > 0 else None
            if rows is None:
                dense.append(a)
            elif len(rows):
                self._take(a, rows, _products(self.w.v[a : a + 1], v[rows])[0], ids, known, labels)
        step = max(1, (1 << 21) // max(1, len(ids)))
        for i in range(0, len(dense), step):
            some = np.array(dense[i : i + step])
            scores = _products(self.w.v[some], v)
            fits = (labels == self.w.labels[some][:, None]) == self.w.same
            fits &= scores >= self.low[some][:, None]
            at, rows = np.nonzero(fits)
            ends = np.searchsorted(at, np.arange(len(some) + 1))
            for j, a in enumerate(some):
                if ends[j + 1] > ends[j]:
                    own = rows[ends[j] : ends[j + 1]]
                    self._take(a, own, scores[j, own], ids, known, labels)

    def _take(self, a: int, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, known: np.ndarray, labels: np.ndarray) -> None:
        fits = (labels[rows] == self.w.labels[a]) == self.w.same
        if self.w.same:
            fits &= (ids[rows] != self.w.ids[a]) | ~known[rows]
        rows, scores = rows[fits], scores[fits].astype(np.int64)
        for i in self.of[a]:
            own = np.flatnonzero((scores >= self.need[i]) & (scores >= self.w.low[i]) & (scores <= self.w.high[i]))
            if not len(own):
                continue
            own = own[_first(scores[own], ids[rows[own]], self.k)]
            s, d, ok = scores[own], ids[rows[own]], known[rows[own]]
            if i in self.found:
                s, d, ok = (np.concatenate(x) for x in zip(self.found[i], (s, d, ok), strict=True))
                own = _first(s, d, self.k)
                s, d, ok = s[own], d[own], ok[own]
            self.found[i] = s, d, ok
            if len(s) == self.k:
                self.need[i] = max(self.need[i], np.nextafter(float(s[-1]), -np.inf))
        if self.of[a]:
            self.low[a] = min(self.need[i] for i in self.of[a])

    def rows(self) -> pa.RecordBatch:
        at = sorted(self.found)
        n = [len(self.found[i][0]) for i in at]
        cells = [np.concatenate([self.found[i][x] for i in at]) if at else np.zeros(0, np.int64) for x in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(at, np.int32), n)), pa.array(cells[0]), pa.array(cells[1], mask=~cells[2].astype(bool))], names=["want", "score", "vec_id"])


def find(blocks: DataFrame, wanted: Wanted, k: int, width: int) -> DataFrame:
    """The first k rows of every want in each task: (want, score, vec_id)."""
    shared = blocks.sparkSession.sparkContext.broadcast(wanted)  # a pass: at most ANCHOR_BYTES of vectors

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value, k)
        for batch in batches:
            for n, ids, known, labels, v, lists in zip(*(batch.column(i) for i in range(6)), strict=True):
                n, raw = n.as_py(), v.as_py()
                values = np.frombuffer(raw, np.int32 if len(raw) == 4 * n * width else np.int64).reshape(n, width).astype(np.int64)
                finder.block(np.frombuffer(ids.as_py(), np.int64), np.frombuffer(known.as_py(), bool), np.frombuffer(labels.as_py(), np.int64), values, np.frombuffer(lists.as_py(), np.uint16).reshape(width, n))
        yield finder.rows()

    return blocks.mapInArrow(search, "want int, score bigint, vec_id bigint")


def _first_of(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("want").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _thresholds(blocks: DataFrame, wanted: Wanted, k: int, width: int) -> Wanted:
    """wanted with the k-th scores of one block as thresholds."""
    seen = find(blocks.limit(1), wanted, k, width).groupBy("want").agg(F.count("*").alias("n"), F.min("score").alias("s")).filter(F.col("n") >= k).toArrow()
    low = wanted.low.astype(object)
    for i, s in zip(seen.column("want").to_pylist(), seen.column("s").to_pylist(), strict=True):
        low[i] = max(low[i], s)
    return Wanted(wanted.ids, wanted.labels, wanted.v, wanted.same, wanted.anchor, low, wanted.high)


_RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def mine(rows: DataFrame, anchors: DataFrame, k: int = 5, n_positives: int = 5, at_least: int = 80, at_most: int = 100, block_rows: int | None = None, pass_anchors: int | None = None) -> DataFrame:
    """rows and anchors (vec_id, label, v), see ``scaled`` -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Negatives of a positive: the first k rows of other labels with at_least * positive <= 100 * negative <= at_most * positive.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "negatives")
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    width = max(1, shape["width"] or 0)
    block_rows = block_rows or max(16, min(8192, BLOCK_BYTES // (8 * width)))
    parts = max(min(spark.sparkContext.defaultParallelism, -(-shape["n"] // 256)), -(-shape["n"] // (4 * block_rows)), 1)
    blocks = scratch.keep(length_blocks(rows, width, block_rows, parts), "blocks")
    pass_anchors = pass_anchors or max(16, ANCHOR_BYTES // (8 * width))
    chosen = anchors.filter(F.col("vec_id").isNotNull()).distinct()
    chosen = scratch.keep(chosen, "anchors", small=True)
    passes = max(1, -(-chosen.count() * 5 // (4 * pass_anchors)))
    results = []
    for number in range(passes):
        mine_now = chosen.filter(F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(passes)) == number).toArrow()
        if not len(mine_now):
            continue
        ids, labels = (mine_now.column(c).to_numpy() for c in ("vec_id", "label"))
        v = _matrix(pa.concat_arrays(mine_now.column("v").chunks), width)
        n = len(ids)
        none, all_scores = np.full(n, -np.inf, object), np.full(n, np.inf, object)
        positives = _thresholds(blocks, Wanted(ids, labels, v, True, np.arange(n), none, all_scores), n_positives, width)
        near = _first_of(find(blocks, positives, n_positives, width), n_positives).select("want", "score", "vec_id").toArrow()  # at most n_positives for an anchor of the pass
        anchor, score = near.column("want").to_numpy(), near.column("score").to_pylist()
        low = np.array([-(-at_least * s // 100) for s in score], object)
        high = np.array([at_most * s // 100 for s in score], object)
        wanted = _thresholds(blocks, Wanted(ids, labels, v, False, anchor, low, high), k, width)
        pairs = pa.table({"want": pa.array(np.arange(len(anchor), dtype=np.int32)), "anchor_id": pa.array(ids[anchor]), "positive_id": near.column("vec_id"), "positive_score": near.column("score")})
        pairs = spark.createDataFrame(pairs) if len(anchor) else spark.createDataFrame([], "want int, anchor_id bigint, positive_id bigint, positive_score bigint")
        found = _first_of(find(blocks, wanted, k, width), k).join(F.broadcast(pairs), "want")  # a pass's pairs
        out = found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        scratch.keep(out, f"pass-{number}", small=True)
        results.append(scratch.path(f"pass-{number}"))
    if not results:
        return spark.createDataFrame([], _RESULT)
    return spark.read.schema(_RESULT).parquet(*results)
