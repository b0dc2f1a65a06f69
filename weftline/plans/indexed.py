"""Queries over stores that are built for look-ups: the vector index, tables in buckets of keys."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine
from ..operators import vector
from ..operators.buckets import BucketStore
from ..operators.labels import LabelIndex
from ..operators.vector_index import VectorIndex
from ..session import shared_folder
from .views import Data, register

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = register(QUERIES, SQL)

_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _folder(d: Data, name: str) -> str:
    return f"{shared_folder(d.spark)}/weftline-{name}-{uuid.uuid4().hex}"


def _index(d: Data) -> VectorIndex:
    return VectorIndex.build(d.embeddings, _folder(d, "index"), id_col="vec_id", vec_col="embedding")


def _asked(d: Data) -> DataFrame:
    return d.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(f"""SELECT query_id, vec_id, score, pos FROM (SELECT q.vec_id AS query_id, e.vec_id, round({_COS}, 6) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) - 1 AS INT) AS pos
FROM {{embeddings}} e, (SELECT * FROM {{embeddings}} WHERE vec_id % 100 = 0) q WHERE {_COS} >= 0.2) r WHERE pos < 10""")
def vec_index_exact(d: Data) -> DataFrame:
    found = _index(d).search(_asked(d), 10, exact=True)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "pos")


@query("SELECT count(*) AS n_queries, TRUE AS recall_reached FROM {embeddings} WHERE vec_id % 100 = 0")
def vec_index_recall(d: Data) -> DataFrame:
    """Whether the index finds nine of ten of the ten nearest rows that a full search finds, over all queries."""
    found = _index(d).search(_asked(d), 10, threshold=-1.0).select("query_id", F.col("id").alias("vec_id"), F.lit(1).alias("hit"))
    asked = _asked(d)
    true = vector.top_k_batch(d.embeddings.withColumnRenamed("embedding", "vector"), asked, 10, threshold=-1.0, tie="vec_id")
    return true.join(found, ["query_id", "vec_id"], "left").agg(F.count_distinct("query_id").alias("n_queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("recall_reached"))


@query("SELECT chunk_id, md5(content) AS content, file_path FROM {text_chunks} WHERE chunk_id IN (SELECT unnest(string_split(source_id, '<SEP>')) FROM {kg_nodes})")
def bucket_lookup(d: Data) -> DataFrame:
    """The texts of all chunks that nodes name, from the buckets of their ids."""
    store = BucketStore(d.spark, _folder(d, "chunks"), "chunk_id string, content string, file_path string", ("chunk_id",))
    store.append(d.text_chunks)
    asked = d.kg_nodes.select(F.explode(F.split("source_id", "<SEP>")).alias("chunk_id"))
    return store.near(asked).select("chunk_id", F.md5("content").alias("content"), "file_path")


@query("""WITH c AS (SELECT 'c' || CAST(o_custkey AS VARCHAR) AS id, 'order ' || CAST(o_orderkey AS VARCHAR) AS name, o_totalprice AS balance FROM {orders} WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
gone AS (SELECT 'c' || CAST(o_custkey AS VARCHAR) AS id FROM {orders} WHERE o_orderstatus = 'P')
SELECT * FROM c UNION ALL SELECT id, name, balance FROM {store} WHERE id NOT IN (SELECT id FROM c) AND id NOT IN (SELECT id FROM gone)""")
def bucket_replace(d: Data) -> DataFrame:
    """A store in buckets after new rows and removals."""
    store = BucketStore(d.spark, _folder(d, "store"), "id string, name string, balance double", ("id",))
    store.append(d.store)
    key = F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id")
    last = F.max(F.struct("o_orderkey", "o_totalprice")).alias("o")
    new = d.orders.filter("o_orderstatus = 'O'").groupBy("o_custkey").agg(last).select(key, F.concat(F.lit("order "), F.col("o.o_orderkey").cast("string")).alias("name"), F.col("o.o_totalprice").alias("balance"))
    store.replace(new, d.orders.filter("o_orderstatus = 'P'").select(key))
    return store.read()


@query("""WITH gone AS (SELECT DISTINCT 'part:' || CAST(l_partkey AS STRING) AS a, 'supplier:' || CAST(l_suppkey AS STRING) AS b FROM {lineitem} WHERE l_returnflag = 'R'),
e AS (SELECT src, tgt FROM {kg_edges} WHERE (src, tgt) NOT IN (SELECT (a, b) FROM gone))
SELECT entity_id, count(*) AS degree FROM (SELECT src AS entity_id FROM e UNION ALL SELECT tgt FROM e) x GROUP BY entity_id""")
def degrees_kept(d: Data) -> DataFrame:
    """Degrees that are kept beside the edges, after edges were written, written again in part, and removed."""
    engine = Engine(d.spark, _folder(d, "graph"))
    engine.put_edges(d.kg_edges)
    engine.put_edges(d.kg_edges.filter("weight > 1"))
    engine.remove_edges(d.lineitem.filter("l_returnflag = 'R'").select(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("tgt")))
    return engine.table("degrees")


_LABELS = ("er:1", "part", "supplier:12", ":9", "nation", "customer:77", "no such")


@query(" UNION ALL ".join(f"SELECT '{x}' AS label, entity_id, CASE WHEN entity_id LIKE 'supplier:%3' THEN 'moved' ELSE entity_type END AS entity_type FROM {{kg_nodes}} WHERE (entity_id LIKE '%{x}%' OR (entity_type = '{x}' AND NOT entity_id LIKE 'supplier:%3')) AND NOT entity_id LIKE 'customer:%7'" for x in _LABELS))
def label_index(d: Data) -> DataFrame:
    """Nodes by substrings of their ids and by their types, from posting lists, after nodes were changed and removed."""
    index = LabelIndex(d.spark, _folder(d, "labels"))
    index.build(d.kg_nodes)
    index.put(d.kg_nodes.filter("entity_id LIKE 'supplier:%3'").withColumn("entity_type", F.lit("moved")))
    index.remove(d.kg_nodes.filter("entity_id LIKE 'customer:%7'").select("entity_id"))
    out = None
    for label in _LABELS:
        rows = index.match(label).select(F.lit(label).alias("label"), "entity_id", "entity_type")
        out = rows if out is None else out.unionByName(rows)
    return out
