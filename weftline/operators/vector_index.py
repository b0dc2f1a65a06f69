"""An index for cosine search: inverted lists of a k-means quantiser, product codes of what is left, exact ranking at the end.

Layout under ``path``: ``model`` (centroids, codebooks and settings), ``lists/gen=<g>/list=<l>`` (id, near, code, vector), ``stats/gen=<g>`` (rows and
smallest cosine to the centroid of each list), ``gone`` (ids that were replaced or removed, with the generation up to which). A search opens the
folders of the lists that it probes and no others, reads codes there, and vectors only for its short list.

* Fitting looks at no more than ``SAMPLE`` rows, chosen by a hash of the id. All rows are indexed.
* ``probes`` is calibrated when the index is built: the smallest number of lists that holds the wanted share of the true neighbours
  of sampled rows, counted against a full search. Vectors without clusters need most lists, clustered ones a few.
* Exact search: a list can be left out if the angle to its centroid, less the list's radius, is wider than that of the k-th hit.
* A list with a large share of all rows is written in several files by several tasks.
* Vectors of length 0 or with a null have no direction and are not indexed. Ties go to the smaller id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from . import kv, vector

#: Rows that fitting looks at; rows that calibrating asks for; rows of one file.
SAMPLE, ASKED, FILE_ROWS = 65_536, 200, 200_000
#: Bytes of centroids, which travel with every task.
CENTROID_BYTES = 64 << 20
NONE_NEAR = 1.0


@dataclass(frozen=True)
class Settings:
    width: int
    subspaces: int
    lists: int
    probes: int
    generation: int
    id_type: str
    vector_type: str


def _kmeans(rows: np.ndarray, k: int, rounds: int, rng: np.random.Generator, unit: bool) -> np.ndarray:
    """Centroids of rows; with ``unit`` of directions, nearest by inner product."""
    k = max(1, min(k, len(rows)))
    centres = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(rows, centres, unit)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        filled = n > 0
        centres[filled] = sums[filled] / n[filled, None]
        if unit:
            centres = _unit(centres)
        # An empty centroid starts anew at a row of the fullest one.
        for c in np.flatnonzero(~filled):
            centres[c] = rows[rng.choice(np.flatnonzero(own == n.argmax()))]
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray, unit: bool) -> np.ndarray:
    out = np.empty(len(rows), np.int64)
    half = 0 if unit else 0.5 * np.square(centres).sum(1)
    for i in range(0, len(rows), 8192):
        out[i : i + 8192] = (rows[i : i + 8192] @ centres.T - half).argmax(1)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.square(rows).sum(-1, keepdims=True))
    return rows / np.where(length > 0, length, 1)


def _encode(rest: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """Codes of residuals, one byte for each subspace."""
    at, out = 0, np.empty((len(rest), len(books)), np.uint8)
    for j, book in enumerate(books):
        out[:, j] = _nearest(rest[:, at : at + book.shape[1]], book, False)
        at += book.shape[1]
    return out


def _directions(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a direction, their unit vectors)."""
    ok, rows = [], []
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == width and None not in v:
            ok.append(i)
            rows.append(v)
    rows = np.array(rows, float).reshape(len(ok), width)
    length = np.sqrt(np.square(rows).sum(1))
    good = np.isfinite(length) & (length > 0)
    return np.array(ok, np.int64)[good], rows[good] / length[good, None]


class _Best:
    """The rows with the highest scores for each query, over all that a task reads; with ``ties`` also those equal to the last."""

    def __init__(self, most: int, ties: float | None = None):
        self.most, self.ties = most, ties
        self.held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        self.count: dict[int, int] = {}

    def add(self, i: int, lists: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.held.setdefault(i, []).append((lists, ids, scores))
        self.count[i] = self.count.get(i, 0) + len(scores)
        if self.count[i] > 4 * self.most:
            self._cut(i)

    def _cut(self, i: int) -> None:
        lists, ids, scores = (np.concatenate(x) for x in zip(*self.held[i], strict=True))
        if len(scores) > self.most:
            last = np.partition(scores, len(scores) - self.most)[len(scores) - self.most]
            at = np.flatnonzero(scores >= last - (self.ties or 0.0))
            at = at if self.ties is not None else at[np.argsort(-scores[at], kind="stable")[: self.most]]
            lists, ids, scores = lists[at], ids[at], scores[at]
        self.held[i], self.count[i] = [(lists, ids, scores)], len(scores)

    def batches(self, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        for i in sorted(self.held):
            self._cut(i)
            lists, ids, scores = self.held[i][0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), i, np.int32)), pa.array(lists.astype(np.int32)), pa.array(ids.tolist(), id_type), pa.array(scores.astype(float))], names=["q", "list", "id", "score"])


class VectorIndex:
    """An index over rows (id, vector) in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        where = kv.current_path(spark, f"{self.path}/model")
        if where is None:
            raise FileNotFoundError(f"no index at {path}")
        rows = spark.read.parquet(where).collect()  # centroids and codebooks: CENTROID_BYTES and 256 rows a subspace
        self.settings = Settings(**json.loads(next(r["text"] for r in rows if r["kind"] == "settings")))
        part = lambda kind: np.array([r["value"] for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["at"])], float)
        self.centres = part("centre")
        self.books = [part(f"book{j}") for j in range(self.settings.subspaces)]
        self._stats: dict[int, tuple[float, list[int]]] | None = None

    @staticmethod
    def build(corpus: DataFrame, path: str, lists: int | None = None, subspaces: int | None = None, target: float = 0.95, k: int = 10, sample: int = SAMPLE, seed: int = 1, id_col: str = "id", vec_col: str = "vector") -> VectorIndex:
        """Index corpus (id, vector) anew."""
        spark, path = corpus.sparkSession, path.rstrip("/")
        kv.remove(spark, path)
        rows = corpus.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vector"))
        shape = rows.agg(F.count("vector").alias("n"), F.max(F.size("vector")).alias("width")).first()
        n, width = shape["n"], max(1, shape["width"] or 0)
        share = max(1, n // max(1, sample))
        fit = rows.filter(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select("vector").limit(sample).toArrow()
        _, fit = _directions(fit.column("vector").combine_chunks() if fit.num_rows else pa.array([], pa.list_(pa.float64())), width)
        rng = np.random.default_rng(seed)
        if not len(fit):
            fit = np.eye(1, width)
        most = max(1, CENTROID_BYTES // (8 * width))
        lists = min(lists or max(1, int(4 * np.sqrt(n))), max(1, len(fit) // 4), most)
        subspaces = min(width, subspaces or max(1, width // 4))
        centres = _kmeans(fit, lists, 8, rng, True)
        rest = fit - centres[_nearest(fit, centres, True)]
        edges = np.linspace(0, width, subspaces + 1).astype(int)
        books = [_kmeans(rest[:, a:b], 256, 6, rng, False) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        settings = Settings(width, subspaces, len(centres), len(centres), 0, rows.schema["id"].dataType.simpleString(), rows.schema["vector"].dataType.simpleString())
        _save(spark, path, settings, centres, books)
        index = VectorIndex(spark, path)
        share_of = np.bincount(_nearest(fit, centres, True), minlength=len(centres)) / len(fit)
        index._write(rows, 1, share_of * n)
        settings = Settings(**{**asdict(settings), "generation": 1, "probes": index._calibrate(rows, target, k, n)})
        _save(spark, path, settings, centres, books)
        return VectorIndex(spark, path)

    def _write(self, rows: DataFrame, generation: int, sizes: np.ndarray) -> None:
        s, centres, books = self.settings, self.centres, self.books
        pieces = np.maximum(1, np.ceil(sizes / FILE_ROWS)).astype(np.int64)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, v = _directions(batch.column(1), s.width)
                own = _nearest(v, centres, True)
                rest = v - centres[own]
                piece = np.arange(len(at)) % pieces[own]
                code = [r.tobytes() for r in _encode(rest, books)]
                near = (v * centres[own]).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(piece.astype(np.int32)), batch.column(0).take(pa.array(at)), pa.array(near), pa.array(code, pa.binary()), batch.column(1).take(pa.array(at))], names=["list", "piece", "id", "near", "code", "vector"])

        made = rows.mapInArrow(assign, f"list int, piece int, id {s.id_type}, near double, code binary, vector {s.vector_type}")
        made = made.repartition("list", "piece").drop("piece").sortWithinPartitions("list")
        made.write.partitionBy("list").parquet(f"{self.path}/lists/gen={generation}")
        stats = self._read([generation]).groupBy("list").agg(F.min("near").alias("near"), F.count("*").alias("n"))
        stats.coalesce(1).write.parquet(f"{self.path}/stats/gen={generation}")  # one row for each list

    def _schema(self) -> str:
        return f"id {self.settings.id_type}, near double, code binary, vector {self.settings.vector_type}, list int"

    def _read(self, generations: list[int], lists: list[int] | None = None) -> DataFrame:
        """Rows of some generations, of some lists: only their folders are opened."""
        parts = []
        for g in generations:
            base = f"{self.path}/lists/gen={g}"
            folders = [base] if lists is None else [f"{base}/list={x}" for x in lists if g in self._where().get(x, (0, []))[1]]
            if folders:
                parts.append(self.spark.read.schema(self._schema()).option("basePath", base).parquet(*folders).withColumn("gen", F.lit(g)))
        if not parts:
            return self.spark.createDataFrame([], self._schema() + ", gen int")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _where(self) -> dict[int, tuple[float, list[int]]]:
        """Smallest cosine to the centroid and generations of each list that has rows."""
        if self._stats is None:
            found: dict[int, tuple[float, list[int]]] = {}
            for g in self._generations():
                for r in self.spark.read.schema("list int, near double, n bigint").parquet(f"{self.path}/stats/gen={g}").collect():
                    near, of = found.get(r["list"], (NONE_NEAR, []))
                    found[r["list"]] = min(near, r["near"]), [*of, g]
            self._stats = found
        return self._stats

    def _generations(self) -> list[int]:
        fs, to_path = kv._files(self.spark, self.path)
        # The settings name the last whole generation: what a lost writer left beyond it is not read.
        return [g for g in range(1, self.settings.generation + 1) if fs.exists(to_path(f"{self.path}/stats/gen={g}/_SUCCESS"))] or ([1] if fs.exists(to_path(f"{self.path}/stats/gen=1/_SUCCESS")) else [])

    def _live(self, lists: list[int]) -> DataFrame:
        """Rows of lists, without those that were replaced or removed later."""
        rows = self._read(self._generations(), lists)
        where = kv.current_path(self.spark, f"{self.path}/gone")
        if where is None:
            return rows
        gone = self.spark.read.schema(f"id {self.settings.id_type}, gen int").parquet(where).groupBy("id").agg(F.max("gen").alias("upto")).withColumnRenamed("id", "__id")
        return rows.join(gone, (F.col("id") == F.col("__id")) & (F.col("gen") <= F.col("upto")), "left_anti")

    def upsert(self, rows: DataFrame, id_col: str = "id", vec_col: str = "vector") -> None:
        """Add rows (id, vector); those with a known id take the place of the older ones. Ids occur once in rows."""
        rows = rows.select(F.col(id_col).cast(self.settings.id_type).alias("id"), F.col(vec_col).alias("vector"))
        g = self.settings.generation + 1
        for part in ("lists", "stats"):
            kv.remove(self.spark, f"{self.path}/{part}/gen={g}")
        self._write(rows, g, np.full(self.settings.lists, rows.count() / self.settings.lists))
        self._forget(rows.select("id"), g - 1)
        self._commit(g)

    def delete(self, ids: DataFrame, id_col: str = "id") -> None:
        self._forget(ids.select(F.col(id_col).alias("id")), self.settings.generation)
        self._commit(self.settings.generation)

    def _forget(self, ids: DataFrame, upto: int) -> None:
        ids.select(F.col("id").cast(self.settings.id_type).alias("id"), F.lit(upto).alias("gen")).distinct().write.mode("append").parquet(f"{self.path}/gone")

    def _commit(self, generation: int) -> None:
        _save(self.spark, self.path, Settings(**{**asdict(self.settings), "generation": generation}), self.centres, self.books)
        self.__init__(self.spark, self.path)

    def _calibrate(self, rows: DataFrame, target: float, k: int, n: int) -> int:
        """Lists to probe, so that the wanted share of the k nearest rows of sampled rows lies in them."""
        rows = rows.filter(F.col("vector").isNotNull() & (F.size("vector") == self.settings.width) & ~F.exists("vector", lambda x: x.isNull()))
        asked = rows.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(max(1, n // (2 * ASKED)))) == 0).limit(ASKED)
        asked = asked.select(F.col("id").cast("string").alias("query_id"), "vector")
        kept = [r for r in asked.collect() if any(r["vector"])]
        if not kept:
            return 1
        asked = self.spark.createDataFrame(kept, asked.schema)
        homes = self._read([1]).select("id", "list")
        true = vector.top_k_batch(rows, asked, k, threshold=-2.0).filter(F.col("query_id") != F.col("id").cast("string"))
        found = true.join(homes, "id").select("query_id", "list").toArrow()  # at most ASKED * k
        _, q = _directions(pa.array([r["vector"] for r in kept], pa.list_(pa.float64())), self.settings.width)
        names = {r["query_id"]: i for i, r in enumerate(kept)}
        if len(q) < len(kept) or not found.num_rows:
            return self.settings.lists
        place = np.argsort(np.argsort(-(q @ self.centres.T), axis=1), axis=1)
        need = np.sort(place[[names[x] for x in found.column("query_id").to_pylist()], found.column("list").to_numpy()])
        return int(need[min(len(need) - 1, int(np.ceil(target * len(need))) - 1)]) + 1

    def search(self, queries: DataFrame, k: int, threshold: float = vector.THRESHOLD, probes: int | None = None, rerank: int | None = None, exact: bool = False, query_id: str = "query_id", vec_col: str = "vector", block: int = vector.MAX_QUERIES) -> DataFrame:
        """queries (query_id, vector) -> (query_id, id, score, pos), the k nearest rows of each with at least the threshold.

        Any number of queries: they are taken in blocks. ``exact`` gives what a full search would give.
        """
        parts = [self._search(b, k, threshold, probes, rerank, exact, query_id) for b in vector.query_blocks(queries.select(query_id, F.col(vec_col).alias("vector")), block)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def lists_for(self, vectors: np.ndarray, probes: int | None = None) -> np.ndarray:
        """The lists that each query (a unit vector) probes, nearest first."""
        some = np.array(sorted(self._where()), np.int64)
        p = min(probes or self.settings.probes, len(some))
        return some[np.argsort(-(vectors @ self.centres[some].T), axis=1, kind="stable")[:, :p]] if len(some) else np.zeros((len(vectors), 0), np.int64)

    def _search(self, queries: list, k: int, threshold: float, probes: int | None, rerank: int | None, exact: bool, query_id: str) -> DataFrame:
        schema, rows = queries
        names_type = schema[query_id].dataType
        ok, q = _directions(pa.array([r["vector"] for r in rows], pa.list_(pa.float64())), self.settings.width)
        names = [rows[i][query_id] for i in ok]
        # For an exact search a few lists are enough: they only give a bound.
        short = rerank or (5 * k if exact else max(200, 30 * k))
        probed = self.lists_for(q, probes or (min(4, self.settings.probes) if exact else None))
        wanted: dict[int, list[int]] = {}
        for i, own in enumerate(probed):
            for x in own:
                wanted.setdefault(int(x), []).append(i)
        found = self._rank(self._short_list(q, wanted, short), q, k, threshold) if wanted else self.spark.createDataFrame([], f"q int, id {self.settings.id_type}, score double, pos int")
        if exact and wanted:
            last = dict(found.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("s")).filter(F.col("n") >= k).select("q", "s").toArrow().to_pandas().itertuples(index=False, name=None))
            floor = np.array([max(threshold, last.get(i, -2.0) - 1e-9) for i in range(len(q))])
            some = self._where()
            keys = np.array(sorted(some))
            angle = np.arccos(np.clip(q @ self.centres[keys].T, -1, 1)) - np.arccos(np.clip([some[x][0] for x in keys], -1, 1)) - 1e-6
            inside = np.cos(np.clip(angle, 0, np.pi)) >= floor[:, None]
            wanted = {int(x): np.flatnonzero(inside[:, j]).tolist() for j, x in enumerate(keys) if inside[:, j].any()}
            found = self._first(self._scan(q, wanted, k, floor), k)
        named = self.spark.createDataFrame(list(enumerate(names)), f"q int, {query_id} {names_type.simpleString()}")
        return found.join(F.broadcast(named), "q").select(query_id, "id", "score", "pos")  # a block's queries

    def _first(self, scored: DataFrame, k: int) -> DataFrame:
        order = W.partitionBy("q").orderBy(F.desc("score"), "id")
        return scored.withColumn("pos", (F.row_number().over(order) - 1).cast("int")).filter(F.col("pos") < k)

    def _short_list(self, q: np.ndarray, wanted: dict[int, list[int]], short: int) -> DataFrame:
        """(q, list, id): the rows of probed lists with the highest scores by code."""
        books, centres = self.books, self.centres
        edges = np.cumsum([0, *(b.shape[1] for b in books)])
        tables = np.stack([np.pad(q[:, a:b] @ book.T, ((0, 0), (0, 256 - len(book)))) for a, b, book in zip(edges[:-1], edges[1:], books, strict=True)], 1)
        shared = self.spark.sparkContext.broadcast((q, tables.astype(np.float32), wanted))
        id_arrow = to_arrow_type(self._read([]).schema["id"].dataType)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, tables, wanted = shared.value
            best = _Best(short)
            for batch in batches:
                lists, codes = batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(batch), -1)
                ids = batch.column(1).to_numpy(zero_copy_only=False)
                for x in np.unique(lists):
                    rows = np.flatnonzero(lists == x)
                    near = q[wanted[int(x)]] @ centres[x]
                    for i, base in zip(wanted[int(x)], near, strict=True):
                        best.add(i, lists[rows], ids[rows], base + tables[i][np.arange(codes.shape[1])[:, None], codes[rows].T].sum(0))
            yield from best.batches(id_arrow)

        rows = self._live(sorted(wanted)).select("list", "id", "code").mapInArrow(score, f"q int, list int, id {self.settings.id_type}, score double")
        return self._first(rows, short).select("q", "list", "id")

    def _rank(self, candidates: DataFrame, q: np.ndarray, k: int, threshold: float) -> DataFrame:
        """The short list by exact cosines."""
        lists = [r["list"] for r in candidates.select("list").distinct().collect()]
        shared = self.spark.sparkContext.broadcast(q)
        width = self.settings.width

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = batch.column(2).flatten().to_numpy().reshape(len(batch), width).astype(float)
                s = np.einsum("ij,ij->i", _unit(v), shared.value[batch.column(0).to_numpy()])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], names=["q", "id", "score"])

        held = self._live(sorted(lists)).select("list", "id", "vector")
        pairs = candidates.join(held, ["list", "id"]).select("q", "id", "vector")
        return self._first(pairs.mapInArrow(exact, f"q int, id {self.settings.id_type}, score double").filter(F.col("score") >= threshold), k)

    def _scan(self, q: np.ndarray, wanted: dict[int, list[int]], k: int, floor: np.ndarray) -> DataFrame:
        """Rows of lists by exact cosines, at least ``floor`` for each query: no more than the k best of a task and those equal to the last."""
        shared = self.spark.sparkContext.broadcast((q, wanted, floor))
        width, id_arrow = self.settings.width, to_arrow_type(self._read([]).schema["id"].dataType)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, wanted, floor = shared.value
            best = _Best(k, 1e-12)
            for batch in batches:
                lists, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
                v = _unit(batch.column(2).flatten().to_numpy().reshape(len(batch), width).astype(float))
                for x in np.unique(lists):
                    rows, own = np.flatnonzero(lists == x), np.array(wanted[int(x)])
                    for i, s in zip(own, q[own] @ v[rows].T, strict=True):
                        at = np.flatnonzero(s >= floor[i])
                        if len(at):
                            best.add(int(i), lists[rows[at]], ids[rows[at]], s[at])
            yield from best.batches(id_arrow)

        found = self._live(sorted(wanted)).select("list", "id", "vector").mapInArrow(scan, f"q int, list int, id {self.settings.id_type}, score double")
        return found.select("q", "id", "score")


def _save(spark: SparkSession, path: str, settings: Settings, centres: np.ndarray, books: list[np.ndarray]) -> None:
    kinds = [("centre", centres), *((f"book{j}", b) for j, b in enumerate(books))]
    rows = [("settings", 0, [], json.dumps(asdict(settings)))]
    rows += [(kind, i, [float(x) for x in r], None) for kind, values in kinds for i, r in enumerate(values)]
    kv.replace_table(spark.createDataFrame(rows, "kind string, at int, value array<double>, text string").coalesce(1), f"{path}/model")
