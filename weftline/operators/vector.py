"""Vector stores: tables with an id and an array of floats; exact cosine search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

#: Query vectors of one batch; they travel with the tasks.
MAX_QUERIES = 4096
#: Scores that a task holds at once, whatever the number of queries and the size of a batch.
SCORES = 1 << 20
THRESHOLD = 0.2


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def normalize(v: Column) -> Column:
    """The vector with length 1, so that a cosine is one dot product."""
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), length))


def top_k(corpus: DataFrame, query: list[float], k: int, threshold: float = THRESHOLD, vector: str = "vector", tie: str = "id") -> DataFrame:
    """The k nearest rows by cosine of at least ``threshold``: columns of the corpus, score and pos (from 0).

    A sort with a limit keeps k rows per task; only k rows reach the last one.
    """
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = corpus.withColumn("score", cosine(F.col(vector), q)).filter(F.col("score") >= threshold)
    best = scored.orderBy(F.desc("score"), tie).limit(k)
    return best.withColumn("pos", F.row_number().over(W.orderBy(F.desc("score"), tie)) - 1)


def top_k_batch(corpus: DataFrame, queries: DataFrame, k: int, threshold: float = THRESHOLD, vector: str = "vector", tie: str = "id", query_id: str = "query_id") -> DataFrame:
    """For a stated set of queries (query_id, vector): (query_id, id, score, pos).

    Queries are taken in blocks of at most MAX_QUERIES. A block goes to every task, which multiplies it with its rows and keeps k rows
    per query; a window over those picks the k best.
    """
    found = None
    for schema, rows in query_blocks(queries.select(query_id, vector), MAX_QUERIES):
        part = _top_k_block(corpus, schema, rows, k, threshold, vector, tie, query_id)
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(W.partitionBy(query_id).orderBy(F.desc("score"), tie)) - 1
    return found.withColumn("pos", rank).filter(F.col("pos") < k)


def query_blocks(queries: DataFrame, most: int) -> Iterator[tuple[T.StructType, list[Row]]]:
    """Queries in blocks of at most ``most``, by ranges of their hash; one block if there are none."""
    rows = queries.limit(most + 1).collect()
    if len(rows) <= most:
        yield queries.schema, rows
        return
    parts = -(-queries.count() * 5 // (4 * most))
    key = F.pmod(F.xxhash64(*queries.columns[:1]), F.lit(parts))
    for i in range(parts):
        rows = queries.filter(key == i).collect()
        for at in range(0, len(rows), most):  # repeated ids share a hash
            yield queries.schema, rows[at : at + most]


def _top_k_block(corpus: DataFrame, schema: T.StructType, rows: list[Row], k: int, threshold: float, vector: str, tie: str, query_id: str) -> DataFrame:
    block = np.array([r[1] for r in rows], float).reshape(len(rows), -1)
    length = np.linalg.norm(block, axis=1, keepdims=True)
    names = [r[0] for r in rows]
    block = block / np.where(length > 0, length, np.nan)
    id_type, query_type = corpus.schema[tie].dataType.simpleString(), schema[query_id].dataType.simpleString()
    query_arrow = to_arrow_type(schema[query_id].dataType)

    rows_at_once = max(1, SCORES // max(1, len(names)))

    def best(s: np.ndarray, at: np.ndarray) -> np.ndarray:
        # Equal scores at the end of the k stay in: the window decides.
        return at[s[at] >= np.partition(s[at], -k)[-k]] if len(at) > k else at

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(batch.column(1).is_valid())
            if not own.num_rows or not names:
                continue
            found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in names]
            for start in range(0, own.num_rows, rows_at_once):
                v = np.array(own.column(1).slice(start, rows_at_once).to_pylist(), float)
                with np.errstate(invalid="ignore", divide="ignore"):
                    score = block @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
                for q, s in enumerate(score):
                    at = best(s, np.flatnonzero(s >= threshold))
                    if len(at):
                        found[q].append((at + start, s[at]))
            for q, parts in enumerate(found):
                if parts:
                    at, s = (np.concatenate(x) for x in zip(*parts, strict=True))
                    last = best(s, np.arange(len(s)))
                    yield pa.RecordBatch.from_arrays([pa.array([names[q]] * len(last), query_arrow), own.column(0).take(pa.array(at[last])), pa.array(s[last])], names=[query_id, tie, "score"])

    return corpus.select(tie, vector).mapInArrow(nearest, f"{query_id} {query_type}, {tie} {id_type}, score double")
