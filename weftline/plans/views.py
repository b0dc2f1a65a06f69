"""Inputs derived from the test tables, in SQL that Spark and DuckDB both read.

``{name}`` names a base table or another view.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_SOURCES = "'d' || CAST(k % 40 AS STRING) || '<SEP>' || 'd' || CAST(k * 7 % 40 AS STRING) || '<SEP>' || 'd' || CAST(k % 7 AS STRING)"

VIEWS = {
    "kg_nodes": f"""
SELECT t || ':' || CAST(k AS STRING) AS entity_id, t AS entity_type, d AS description, {_SOURCES} AS source_id, 'f' || CAST(k % 9 AS STRING) || '.md' AS file_path
FROM (SELECT 'region' AS t, CAST(r_regionkey AS BIGINT) AS k, r_name AS d FROM {{region}}
      UNION ALL SELECT 'nation', CAST(n_nationkey AS BIGINT), n_name FROM {{nation}}
      UNION ALL SELECT 'customer', c_custkey, c_name || ' ' || c_mktsegment FROM {{customer}}
      UNION ALL SELECT 'supplier', s_suppkey, s_name FROM {{supplier}}
      UNION ALL SELECT 'part', p_partkey, p_name || ' ' || p_type FROM {{part}}) n""",
    "kg_edges": f"""
SELECT least(a, b) AS src, greatest(a, b) AS tgt, kind || ' link' AS description, kind AS keywords, w AS weight, {_SOURCES} AS source_id, 'f' || CAST(k % 9 AS STRING) || '.md' AS file_path
FROM (SELECT 'nation:' || CAST(n_nationkey AS STRING) AS a, 'region:' || CAST(n_regionkey AS STRING) AS b, 'lies in' AS kind, CAST(1 AS DOUBLE) AS w, CAST(n_nationkey AS BIGINT) AS k FROM {{nation}}
      UNION ALL SELECT 'customer:' || CAST(c_custkey AS STRING), 'nation:' || CAST(c_nationkey AS STRING), 'lives in', CAST(1 AS DOUBLE), c_custkey FROM {{customer}}
      UNION ALL SELECT 'supplier:' || CAST(s_suppkey AS STRING), 'nation:' || CAST(s_nationkey AS STRING), 'works in', CAST(2 AS DOUBLE), s_suppkey FROM {{supplier}}
      UNION ALL SELECT 'supplier:' || CAST(l_suppkey AS STRING), 'part:' || CAST(l_partkey AS STRING), 'ships', CAST(count(*) AS DOUBLE), l_suppkey + l_partkey FROM {{lineitem}} GROUP BY l_suppkey, l_partkey) e""",
    "tree_edges": "SELECT * FROM {kg_edges} WHERE keywords <> 'ships'",
    "ents": "SELECT entity_id FROM {kg_nodes} WHERE entity_type <> 'part'",
    # A vector belongs to the customer with its number, or to that customer's edge.
    "ent_vec": "SELECT e.vec_id, e.embedding, n.entity_id FROM {embeddings} e JOIN {kg_nodes} n ON n.entity_id = 'customer:' || CAST(e.vec_id AS STRING)",
    "rel_vec": "SELECT e.vec_id, e.embedding, CASE WHEN vec_id % 2 = 1 THEN tgt ELSE src END AS src, CASE WHEN vec_id % 2 = 1 THEN src ELSE tgt END AS tgt FROM {embeddings} e JOIN {tree_edges} r ON r.src = 'customer:' || CAST(e.vec_id AS STRING)",
    "text_chunks": "SELECT 'd' || CAST(doc_id AS STRING) AS chunk_id, text AS content, source AS file_path FROM {documents}",
    "store": "SELECT 'c' || CAST(c_custkey AS STRING) AS id, c_name AS name, c_acctbal AS balance FROM {customer}",
    # Ranked lists, as a search would give them: the first 40 by some order.
    "rank_a": "SELECT 'customer:' || CAST(c_custkey AS STRING) AS entity_id, c_name AS description, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS INT) AS pos FROM (SELECT * FROM {customer} ORDER BY c_acctbal DESC, c_custkey LIMIT 40) r",
    "rank_b": "SELECT 'customer:' || CAST(c_custkey AS STRING) AS entity_id, c_name AS description, CAST(row_number() OVER (ORDER BY c_nationkey, c_acctbal DESC, c_custkey) - 1 AS INT) AS pos FROM (SELECT * FROM {customer} WHERE c_acctbal > 6000 ORDER BY c_nationkey, c_acctbal DESC, c_custkey LIMIT 40) r",
    "rank_rel_a": "SELECT src, tgt, keywords, description, source_id, CAST(row_number() OVER (ORDER BY description, src, tgt) - 1 AS INT) AS pos FROM (SELECT * FROM {tree_edges} ORDER BY description, src, tgt LIMIT 40) r",
    "rank_rel_b": "SELECT tgt AS src, src AS tgt, keywords, description, source_id, CAST(row_number() OVER (ORDER BY source_id DESC, src, tgt) - 1 AS INT) AS pos FROM (SELECT * FROM {tree_edges} WHERE keywords <> 'lives in' OR source_id < 'd2' ORDER BY source_id DESC, src, tgt LIMIT 40) r",
    "rank_ent": "SELECT entity_id, entity_type, description, source_id, CAST(row_number() OVER (ORDER BY source_id, entity_id) - 1 AS INT) AS pos FROM (SELECT * FROM {kg_nodes} WHERE entity_type <> 'part' ORDER BY source_id, entity_id LIMIT 40) r",
    "rank_chunk": "SELECT 'd' || CAST(doc_id AS STRING) AS chunk_id, text AS content, source AS file_path, CAST(row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS INT) AS pos FROM (SELECT * FROM {documents} ORDER BY n_chars, doc_id LIMIT 40) r",
    "rank_chunk_b": "SELECT 'd' || CAST(doc_id AS STRING) AS chunk_id, text AS content, source AS file_path, CAST(row_number() OVER (ORDER BY source, n_chars, doc_id) - 1 AS INT) AS pos FROM (SELECT * FROM {documents} WHERE n_chars < 400 ORDER BY source, n_chars, doc_id LIMIT 40) r",
    "rank_chunk_c": "SELECT 'd' || CAST(doc_id AS STRING) AS chunk_id, text AS content, source AS file_path, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS INT) AS pos FROM (SELECT * FROM {documents} ORDER BY doc_id LIMIT 40) r",
    "distinct_docs": "SELECT 'd' || CAST(min(doc_id) AS STRING) AS full_doc_id, min(source) AS file_path, text AS content FROM {documents} GROUP BY text",
    # Facts as a model would find them: suppliers and what they ship.
    "entity_facts": """
SELECT 'N' || CAST(k % 97 AS STRING) AS name, CASE WHEN k % 5 = 0 THEN ' ' WHEN k % 3 = 0 THEN 'person' ELSE 'org' END AS type,
       CASE WHEN k % 11 = 0 THEN '' ELSE 'desc ' || CAST(k % 13 AS STRING) || ' of ' || CAST(k % 97 AS STRING) END AS description,
       'd' || CAST(k % 53 AS STRING) AS source_id, 'f' || CAST(k % 6 AS STRING) || '.md' AS file_path, k % 10 AS timestamp, CAST(k % 17 AS INT) AS chunk_ord, CAST(k AS INT) AS ord, 'doc' || CAST(k % 4 AS STRING) AS full_doc_id
FROM (SELECT p_partkey AS k FROM {part}) p""",
    "relation_facts": """
SELECT 'N' || CAST(l_suppkey % 23 AS STRING) AS source_id, 'N' || CAST(l_partkey % 19 AS STRING) AS target_id, CASE WHEN l_linenumber = 1 THEN 'ships, ' || l_returnflag ELSE l_linestatus || ' ,b,,a' END AS keywords,
       'line ' || CAST(l_linenumber AS STRING) AS description, CAST(l_linenumber AS FLOAT) AS weight, 'd' || CAST(l_partkey % 31 AS STRING) AS source_chunk_id, 'f' || CAST(l_suppkey % 6 AS STRING) || '.md' AS file_path,
       l_orderkey % 10 AS timestamp, CAST(l_orderkey % 17 AS INT) AS chunk_ord, CAST(l_orderkey * 10 + l_linenumber AS INT) AS ord, 'doc' || CAST(l_suppkey % 4 AS STRING) AS full_doc_id
FROM {lineitem}""",
    "old_nodes": "SELECT 'N' || CAST(n_nationkey AS STRING) AS entity_id, CASE WHEN n_regionkey = 0 THEN 'person' ELSE 'place' END AS entity_type, 'old<SEP>desc 1 of ' || CAST(n_nationkey AS STRING) AS description, 'd60<SEP>d' || CAST(n_nationkey AS STRING) AS source_id, 'f0.md<SEP>...truncated...(FIFO)' AS file_path FROM {nation}",
    "responses": """
SELECT 'd' || CAST(p_partkey AS STRING) AS chunk_id,
       'entity<|#|>"' || p_name || '"<|#|>' || p_type || '<|#|>made  by ' || p_brand || chr(10) || 'relation<|#|>' || p_name || '<|#|>' || p_brand || '<|#|>made, by<|#|>size ' || CAST(p_size AS STRING) ||
       CASE WHEN p_size % 2 = 0 THEN '<|#|>"' || CAST(p_size AS STRING) || '.5"' ELSE '' END || chr(10) || 'noise<|#|>x' || chr(10) || CASE WHEN p_size % 3 = 0 THEN '<|COMPLETE|>' || chr(10) ELSE '' END || 'entity<|#|>' || p_brand || '<|#|>Brand<|#|>a brand' AS response
FROM {part}""",
    "tasks": """
SELECT 't' || CAST(o_orderkey AS STRING) AS task_id, CAST(o_custkey AS INT) AS document_id, CASE o_orderstatus WHEN 'O' THEN 'Pending' WHEN 'F' THEN 'Failed' ELSE 'Processing' END AS status,
       CASE WHEN o_orderkey % 3 = 0 THEN 'MergingEntities' ELSE 'Persisting' END AS current_stage, CAST(o_orderkey % 100 AS INT) AS progress, CAST(left(o_orderpriority, 1) AS INT) AS priority, o_orderdate AS created_at
FROM {orders}""",
    "task_log": """
SELECT 't' || CAST(user_id AS STRING) AS task_id, event_id AS seq,
       CASE event_id % 9 WHEN 0 THEN 'enqueue' WHEN 1 THEN 'start' WHEN 2 THEN 'progress' WHEN 3 THEN 'fail' WHEN 4 THEN 'retry' WHEN 5 THEN 'start' WHEN 6 THEN 'complete' WHEN 7 THEN 'reorder' ELSE 'stop' END AS op, CAST(event_id % 130 AS INT) AS arg
FROM {events}""",
    "state_events": """
SELECT 'doc' || CAST(user_id AS STRING) AS doc_id, event_id AS seq, event_type AS stage, event_id % 17 AS current, CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 13 + 1 END AS total
FROM {events}""",
    "markdown": """
SELECT CAST(o_orderkey AS INT) AS id, 'file' || CAST(o_orderkey AS STRING) || '.md' AS file_name, o_orderdate AS upload_time, CASE o_orderstatus WHEN 'O' THEN 'Pending' WHEN 'F' THEN 'Completed' ELSE 'Failed' END AS rag_status,
       CAST(o_orderkey % 50 AS INT) AS rag_progress, o_orderstatus = 'F' AS is_in_rag_system
FROM {orders}""",
    "live": "SELECT CAST(o_orderkey AS INT) AS document_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Processing' ELSE 'Completed' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'MergingEntities' ELSE 'Persisting' END AS current_stage, CAST(o_orderkey % 100 AS INT) AS progress FROM {orders} WHERE o_orderkey % 5 < 2",
    "answers": """
SELECT event_id AS seq, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type || ' "' || CAST(user_id AS STRING) || '"' END AS text FROM {events}""",
}


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z]\w*)\}", sql)))


class Data:
    """Test tables and views as DataFrames: ``data.kg_nodes``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in VIEWS:
                self._made[name] = self.spark.sql(VIEWS[name], **{n: getattr(self, n) for n in _names(VIEWS[name])})
            elif name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._made[name]


def oracle(sql: str) -> str:
    """A query over views as DuckDB SQL, with the views in front."""
    order: list[str] = []

    def visit(text: str) -> None:
        for n in _names(text):
            if n in VIEWS and n not in order:
                visit(VIEWS[n])
                order.append(n)

    visit(sql)
    plain = lambda s: re.sub(r"\{([a-z]\w*)\}", r"\1", s)
    heads = [f"{n} AS ({plain(VIEWS[n])})" for n in order]
    body = plain(sql).strip()
    if not heads:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(heads) + ", " + body[len("WITH RECURSIVE") :]
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(heads) + ", " + body[len("WITH ") :]
    return "WITH " + ", ".join(heads) + " " + body


def register(queries: dict, sql: dict) -> Callable:
    """Decorator: a query over ``Data`` under its name, with its oracle."""

    def keep(said: str | None = None) -> Callable:
        def wrap(f: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
            queries[f.__name__] = lambda spark, sf_dir: f(Data(spark, sf_dir))
            if said is not None:
                sql[f.__name__] = oracle(said)
            return f

        return wrap

    return keep
