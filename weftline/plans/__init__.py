"""Registered queries over the test tables, and DuckDB SQL with the same results."""

from __future__ import annotations

from . import batch, indexed, ingest, queue, retrieval, stores

QUERIES = stores.QUERIES | retrieval.QUERIES | ingest.QUERIES | queue.QUERIES | indexed.QUERIES | batch.QUERIES
ORACLE_SQL = stores.SQL | retrieval.SQL | ingest.SQL | queue.SQL | indexed.SQL | batch.SQL

#: Names of queries that once looked at a part of the graph; they are those of the whole graph now.
for _name in ("graph_edge_degrees", "graph_node_edges", "graph_upsert_edges", "graph_delete_node", "graph_subgraph", "merge_missing_endpoints", "merge_relation_vector_replace"):
    QUERIES[_name], ORACLE_SQL[_name] = QUERIES[f"{_name}_all"], ORACLE_SQL[f"{_name}_all"]
