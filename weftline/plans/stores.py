"""Queries of the vector, key-value and graph stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, kv, vector
from .views import Data, register

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = register(QUERIES, SQL)

_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def query_vector(d: Data, vec_id: int = 0) -> list[float]:
    return d.embeddings.filter(F.col("vec_id") == vec_id).first()["embedding"]


@query(f"SELECT CAST(row_number() OVER (ORDER BY {_COS} DESC, e.vec_id) - 1 AS INT) AS pos, e.vec_id, round({_COS}, 6) AS score FROM {{embeddings}} e, (SELECT embedding FROM {{embeddings}} WHERE vec_id = 0) q WHERE {_COS} >= 0.2 ORDER BY {_COS} DESC, e.vec_id LIMIT 40")
def vec_topk(d: Data) -> DataFrame:
    return vector.top_k(d.embeddings, query_vector(d), 40, vector="embedding", tie="vec_id").select("pos", "vec_id", F.round("score", 6).alias("score"))


@query(f"""SELECT query_id, vec_id, score, pos FROM (SELECT q.vec_id AS query_id, e.vec_id, round({_COS}, 6) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) - 1 AS INT) AS pos
FROM {{embeddings}} e, (SELECT * FROM {{embeddings}} WHERE vec_id % 100 = 0) q WHERE {_COS} >= 0.2) r WHERE pos < 10""")
def vec_topk_batch(d: Data) -> DataFrame:
    asked = d.embeddings.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return vector.top_k_batch(d.embeddings, asked, 10, vector="embedding", tie="vec_id").select("query_id", "vec_id", F.round("score", 6).alias("score"), "pos")


_IDS = ["7", "400", "no", "3", "7"]


@query("SELECT pos, vec_id, label FROM (VALUES (0, '7'), (1, '400'), (2, 'no'), (3, '3'), (4, '7')) k(pos, id) JOIN {embeddings} ON CAST(vec_id AS VARCHAR) = k.id")
def vec_get_by_ids(d: Data) -> DataFrame:
    return kv.get_by_ids(d.embeddings, _IDS, "vec_id").select("pos", "vec_id", "label")


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM {embeddings} UNION ALL SELECT vec_id + 1000000, label FROM {embeddings} WHERE vec_id % 50 = 0")
def vec_upsert(d: Data) -> DataFrame:
    changed = d.embeddings.filter("vec_id % 3 = 0").withColumn("label", F.col("label") + 100).unionByName(d.embeddings.filter("vec_id % 50 = 0").withColumn("vec_id", F.col("vec_id") + 1000000))
    return kv.upsert(d.embeddings, changed, F.col("vec_id"), "vec_id").select("vec_id", "label")


@query("SELECT vec_id, label FROM {embeddings} WHERE vec_id % 4 <> 0")
def vec_delete(d: Data) -> DataFrame:
    return kv.delete(d.embeddings, d.embeddings.filter("vec_id % 4 = 0").select(F.col("vec_id").alias("id")), "vec_id").select("vec_id", "label")


@query("SELECT id, name, balance FROM {store} WHERE id = 'c7'")
def kv_get_by_id(d: Data) -> DataFrame:
    return kv.get_by_id(d.store, "c7")


@query("SELECT pos, s.id, name FROM (VALUES (0, 'c5'), (1, 'nope'), (2, 'c2'), (3, 'c5')) k(pos, id) JOIN {store} s ON s.id = k.id")
def kv_get_by_ids(d: Data) -> DataFrame:
    return kv.get_by_ids(d.store, ["c5", "nope", "c2", "c5"]).select("pos", "id", "name")


@query("SELECT DISTINCT 'c' || CAST(o_custkey * 2 AS VARCHAR) AS id FROM {orders} WHERE 'c' || CAST(o_custkey * 2 AS VARCHAR) NOT IN (SELECT id FROM {store})")
def kv_filter_keys(d: Data) -> DataFrame:
    return kv.missing_keys(d.store, d.orders.select(F.concat(F.lit("c"), (F.col("o_custkey") * 2).cast("string")).alias("id")))


@query("SELECT count(*) = 0 AS is_empty FROM {store}")
def kv_is_empty(d: Data) -> DataFrame:
    return kv.is_empty(d.store)


@query("""WITH c AS (SELECT 'c' || CAST(o_custkey AS VARCHAR) AS id, 'order ' || CAST(o_orderkey AS VARCHAR) AS name, o_totalprice AS balance, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM {orders})
SELECT id, name, balance FROM c WHERE k = 1 UNION ALL SELECT id, name, balance FROM {store} WHERE id NOT IN (SELECT id FROM c)""")
def kv_upsert(d: Data) -> DataFrame:
    changes = d.orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_totalprice").alias("balance"), "o_orderkey")
    return kv.upsert(d.store.withColumn("o_orderkey", F.lit(None).cast("bigint")), changes, F.col("o_orderkey")).select("id", "name", "balance")


@query("SELECT id, name, balance FROM {store} WHERE id NOT IN (SELECT 'c' || CAST(o_custkey AS VARCHAR) FROM {orders} WHERE o_orderstatus = 'F')")
def kv_delete(d: Data) -> DataFrame:
    return kv.delete(d.store, d.orders.filter("o_orderstatus = 'F'").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id")))


def _nodes(d: Data) -> DataFrame:
    return d.kg_nodes.withColumn("labels", F.array(F.lit("kg"), "entity_type"))


_PAIRS = "SELECT 'part:' || CAST(l_partkey AS STRING) AS src, 'supplier:' || CAST(l_suppkey + l_linenumber % 2 AS STRING) AS tgt FROM {lineitem} WHERE l_returnflag = 'R'"


def _pairs(d: Data) -> DataFrame:
    return d.spark.sql(_PAIRS, lineitem=d.lineitem)


@query("SELECT n.entity_id, entity_type, description FROM {kg_nodes} n WHERE entity_id IN (SELECT 'customer:' || CAST(o_custkey AS VARCHAR) FROM {orders})")
def graph_nodes_batch(d: Data) -> DataFrame:
    ids = d.orders.select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("entity_id"))
    return graph.nodes_batch(d.kg_nodes, ids).select("entity_id", "entity_type", "description")


@query(f"SELECT DISTINCT p.src, p.tgt, e.weight, e.keywords FROM ({_PAIRS}) p JOIN {{kg_edges}} e ON e.src = least(p.src, p.tgt) AND e.tgt = greatest(p.src, p.tgt)")
def graph_edges_batch(d: Data) -> DataFrame:
    # Asked the other way round as well: the caller's orientation comes back.
    return graph.edges_batch(d.kg_edges, _pairs(d)).select("src", "tgt", "weight", "keywords")


@query(f"SELECT p.src, p.tgt, e.src IS NOT NULL AS has_edge FROM (SELECT DISTINCT tgt AS src, src AS tgt FROM ({_PAIRS}) x) p LEFT JOIN (SELECT DISTINCT src, tgt FROM {{kg_edges}}) e ON e.src = least(p.src, p.tgt) AND e.tgt = greatest(p.src, p.tgt)")
def graph_has_edge(d: Data) -> DataFrame:
    return graph.has_edge(d.kg_edges, _pairs(d).select(F.col("tgt").alias("src"), F.col("src").alias("tgt")).distinct())


_DEG = "SELECT x AS entity_id, count(*) AS degree FROM (SELECT src AS x FROM {kg_edges} UNION ALL SELECT tgt FROM {kg_edges}) u GROUP BY x"


@query(f"SELECT n.entity_id, coalesce(g.degree, 0) AS degree FROM {{kg_nodes}} n LEFT JOIN ({_DEG}) g USING (entity_id)")
def graph_degrees(d: Data) -> DataFrame:
    return graph.node_degrees(d.kg_edges, d.kg_nodes)


@query(f"SELECT t.src, t.tgt, coalesce(a.degree, 0) + coalesce(b.degree, 0) AS rank FROM {{tree_edges}} t LEFT JOIN ({_DEG}) a ON a.entity_id = t.src LEFT JOIN ({_DEG}) b ON b.entity_id = t.tgt")
def graph_edge_degrees(d: Data) -> DataFrame:
    return graph.edge_degrees(d.kg_edges, d.tree_edges.select("src", "tgt"))


@query("SELECT n.entity_id, e.neighbour FROM {ents} n LEFT JOIN (SELECT src AS entity_id, tgt AS neighbour FROM {kg_edges} UNION ALL SELECT tgt, src FROM {kg_edges}) e USING (entity_id)")
def graph_node_edges(d: Data) -> DataFrame:
    return graph.node_edges(d.kg_edges, d.ents)


@query("SELECT DISTINCT entity_type AS label FROM {kg_nodes}")
def graph_labels(d: Data) -> DataFrame:
    return graph.labels(_nodes(d), "kg")


@query("SELECT entity_type AS label, count(*) AS n_nodes FROM {kg_nodes} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 300")
def graph_popular_labels(d: Data) -> DataFrame:
    return graph.popular_labels(_nodes(d), "kg")


@query("SELECT entity_id, entity_type FROM {kg_nodes} WHERE contains(entity_id, 'nation') OR entity_type = 'nation'")
def graph_match_label(d: Data) -> DataFrame:
    return graph.match_label(d.kg_nodes, "nation").select("entity_id", "entity_type")


@query("""SELECT coalesce(n.entity_id, c.entity_id) AS entity_id, coalesce(c.entity_type, n.entity_type) AS entity_type, n.description,
CASE WHEN c.entity_id IS NULL THEN 'kg,' || n.entity_type WHEN n.entity_id IS NULL THEN 'buyer' ELSE 'kg,' || n.entity_type || ',buyer' END AS labels
FROM {kg_nodes} n FULL OUTER JOIN (SELECT DISTINCT 'customer:' || CAST(o_custkey * 2 AS VARCHAR) AS entity_id, 'buyer' AS entity_type FROM {orders}) c ON n.entity_id = c.entity_id""")
def graph_upsert_nodes(d: Data) -> DataFrame:
    changes = d.orders.select(F.concat(F.lit("customer:"), (F.col("o_custkey") * 2).cast("string")).alias("entity_id"), F.lit("buyer").alias("entity_type")).distinct()
    return graph.upsert_nodes(_nodes(d), changes).select("entity_id", "entity_type", "description", F.array_join("labels", ",").alias("labels"))


@query("""WITH c AS (SELECT least(a, b) AS src, greatest(a, b) AS tgt, max(w) AS weight FROM (SELECT 'customer:' || CAST(c_custkey AS VARCHAR) AS a, 'nation:' || CAST(c_nationkey + 1 AS VARCHAR) AS b, c_acctbal AS w FROM {customer}) x GROUP BY 1, 2)
SELECT coalesce(e.src, c.src) AS src, coalesce(e.tgt, c.tgt) AS tgt, coalesce(c.weight, e.weight) AS weight, e.keywords FROM {tree_edges} e FULL OUTER JOIN c ON e.src = c.src AND e.tgt = c.tgt""")
def graph_upsert_edges(d: Data) -> DataFrame:
    changes = d.customer.select(F.concat(F.lit("nation:"), (F.col("c_nationkey") + 1).cast("string")).alias("src"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("tgt"), F.col("c_acctbal").alias("weight"))
    return graph.upsert_edges(_nodes(d), d.tree_edges, changes)[1].select("src", "tgt", "weight", "keywords")


@query("SELECT src, tgt, keywords FROM {tree_edges} WHERE src NOT IN ('nation:3', 'customer:5') AND tgt NOT IN ('nation:3', 'customer:5')")
def graph_delete_node(d: Data) -> DataFrame:
    ids = d.kg_nodes.filter(F.col("entity_id").isin("nation:3", "customer:5"))
    return graph.delete_nodes(d.kg_nodes, d.tree_edges, ids)[1].select("src", "tgt", "keywords")


@query("SELECT src, tgt, weight FROM {kg_edges} WHERE NOT (keywords = 'ships' AND weight < 2)")
def graph_remove_edges(d: Data) -> DataFrame:
    gone = d.kg_edges.filter("keywords = 'ships' AND weight < 2").select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))
    return graph.remove_edges(d.kg_edges, gone).select("src", "tgt", "weight")


@query("SELECT DISTINCT least(c_mktsegment, c_name) AS low, greatest(c_mktsegment, c_name) AS high FROM {customer}")
def canonical_pair(d: Data) -> DataFrame:
    low, high = graph.canonical(F.col("c_mktsegment"), F.col("c_name"))
    return d.customer.select(low.alias("low"), high.alias("high")).distinct()


@query("""WITH RECURSIVE b AS (SELECT src AS a, tgt AS b FROM {tree_edges} UNION ALL SELECT tgt, src FROM {tree_edges}),
w(start, connected, depth, path) AS (SELECT entity_id, entity_id, 0, [entity_id] FROM {kg_nodes} WHERE contains(entity_id, 'region') OR entity_type = 'region'
 UNION ALL SELECT start, b.b, depth + 1, list_append(path, b.b) FROM w JOIN b ON w.connected = b.a WHERE depth < 3 AND NOT list_contains(path, b.b))
SELECT start, connected, CAST(min(depth) AS INT) AS depth FROM w WHERE depth > 0 GROUP BY 1, 2 ORDER BY 3, 1, 2 LIMIT 1000""")
def graph_subgraph(d: Data) -> DataFrame:
    # The tree has no cycles: paths without a repeated edge are those without a repeated node.
    return graph.subgraph_pairs(d.kg_nodes, d.tree_edges, "region", 3, 1000)


@query(f"""SELECT n.entity_id, CASE WHEN length(n.entity_id) > 20 THEN n.entity_id[1:17] || '...' ELSE n.entity_id END AS label, entity_type, CAST(round(greatest(8.0, least(35.0, 8 + 4 * sqrt(coalesce(g.degree, 0)))), 6) AS DOUBLE) AS size
FROM {{kg_nodes}} n LEFT JOIN ({_DEG}) g USING (entity_id)""")
def graph_view(d: Data) -> DataFrame:
    return graph.view(d.kg_nodes, d.kg_edges).select("entity_id", "label", "entity_type", F.round("size", 6).alias("size"))


# The queries above whose SQL leaves out the edges of kind 'ships' (or the parts), over the whole graph.


@query(f"SELECT t.src, t.tgt, a.degree + b.degree AS rank FROM {{kg_edges}} t JOIN ({_DEG}) a ON a.entity_id = t.src JOIN ({_DEG}) b ON b.entity_id = t.tgt")
def graph_edge_degrees_all(d: Data) -> DataFrame:
    return graph.edge_degrees(d.kg_edges, d.kg_edges.select("src", "tgt"))


@query("SELECT n.entity_id, e.neighbour FROM {kg_nodes} n LEFT JOIN (SELECT src AS entity_id, tgt AS neighbour FROM {kg_edges} UNION ALL SELECT tgt, src FROM {kg_edges}) e USING (entity_id)")
def graph_node_edges_all(d: Data) -> DataFrame:
    return graph.node_edges(d.kg_edges, d.kg_nodes)


@query("""WITH c AS (SELECT least(a, b) AS src, greatest(a, b) AS tgt, max(w) AS weight FROM (SELECT 'customer:' || CAST(c_custkey AS VARCHAR) AS a, 'nation:' || CAST(c_nationkey + 1 AS VARCHAR) AS b, c_acctbal AS w FROM {customer}) x GROUP BY 1, 2)
SELECT coalesce(e.src, c.src) AS src, coalesce(e.tgt, c.tgt) AS tgt, coalesce(c.weight, e.weight) AS weight, e.keywords FROM {kg_edges} e FULL OUTER JOIN c ON e.src = c.src AND e.tgt = c.tgt""")
def graph_upsert_edges_all(d: Data) -> DataFrame:
    changes = d.customer.select(F.concat(F.lit("nation:"), (F.col("c_nationkey") + 1).cast("string")).alias("src"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("tgt"), F.col("c_acctbal").alias("weight"))
    return graph.upsert_edges(_nodes(d), d.kg_edges, changes)[1].select("src", "tgt", "weight", "keywords")


@query("SELECT src, tgt, keywords FROM {kg_edges} WHERE src NOT IN ('nation:3', 'supplier:5') AND tgt NOT IN ('nation:3', 'supplier:5')")
def graph_delete_node_all(d: Data) -> DataFrame:
    ids = d.kg_nodes.filter(F.col("entity_id").isin("nation:3", "supplier:5"))
    return graph.delete_nodes(d.kg_nodes, d.kg_edges, ids)[1].select("src", "tgt", "keywords")


@query("""WITH RECURSIVE b AS (SELECT src AS a, tgt AS b, src || '|' || tgt AS e FROM {kg_edges} UNION ALL SELECT tgt, src, src || '|' || tgt FROM {kg_edges}),
w(start, connected, depth, used) AS (SELECT entity_id, entity_id, 0, CAST([] AS VARCHAR[]) FROM {kg_nodes} WHERE contains(entity_id, 'region') OR entity_type = 'region'
 UNION ALL SELECT start, b.b, depth + 1, list_append(used, b.e) FROM w JOIN b ON w.connected = b.a WHERE depth < 3 AND NOT list_contains(used, b.e))
SELECT start, connected, CAST(min(depth) AS INT) AS depth FROM w WHERE depth > 0 GROUP BY 1, 2 ORDER BY 3, 1, 2 LIMIT 1000""")
def graph_subgraph_all(d: Data) -> DataFrame:
    return graph.subgraph_pairs(d.kg_nodes, d.kg_edges, "region", 3, 1000)


@query(f"""SELECT entity_id, CASE entity_type WHEN 'person' THEN '#FF6B6B' ELSE (['#FF6B6B', '#4ECDC4', '#95E1D3', '#F38181', '#AA96DA', '#FCBAD3', '#A8DADC', '#FFD93D', '#6BCB77', '#4D96FF', '#9B59B6'])[CAST(entity_type[7:] AS INT)] END AS color
FROM (SELECT entity_id, CASE WHEN entity_type = 'customer' THEN 'person' ELSE CASE entity_type WHEN 'part' THEN 'colour9' WHEN 'supplier' THEN 'colour2' WHEN 'nation' THEN 'colour3' ELSE 'colour5' END END AS entity_type FROM {{kg_nodes}}) x""")
def graph_view_colors(d: Data) -> DataFrame:
    known = {"customer": "Person", "part": "artifact", "supplier": "ORGANIZATION", "nation": "location", "region": "event"}
    kinds = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return graph.view(d.kg_nodes.withColumn("entity_type", F.element_at(kinds, F.col("entity_type"))), d.kg_edges).select("entity_id", "color")


_WALK = """WITH RECURSIVE b AS (SELECT src AS a, tgt AS b, src || '|' || tgt AS e FROM {kg_edges} UNION ALL SELECT tgt, src, src || '|' || tgt FROM {kg_edges}),
w(start, connected, depth, used) AS (SELECT entity_id, entity_id, 0, CAST([] AS VARCHAR[]) FROM {kg_nodes} WHERE contains(entity_id, 'region') OR entity_type = 'region'
 UNION ALL SELECT start, b.b, depth + 1, list_append(used, b.e) FROM w JOIN b ON w.connected = b.a WHERE depth < 2 AND NOT list_contains(used, b.e)),
p AS (SELECT start, connected, min(depth) AS depth FROM w WHERE depth > 0 GROUP BY 1, 2 ORDER BY 3, 1, 2 LIMIT 40),
ends AS (SELECT entity_id, min(depth) AS depth FROM (SELECT start AS entity_id, depth FROM p UNION ALL SELECT connected, depth FROM p) x GROUP BY 1),
kept AS (SELECT entity_id FROM ends ORDER BY depth, entity_id LIMIT 40),
cut AS (SELECT count(*) > 40 AS is_truncated FROM ends)"""


@query(f"""{_WALK} SELECT 'node' AS kind, n.entity_id AS a, '' AS b, is_truncated FROM {{kg_nodes}} n JOIN kept USING (entity_id), cut
UNION ALL SELECT 'edge', src, tgt, is_truncated FROM {{kg_edges}}, cut WHERE src IN (SELECT entity_id FROM kept) AND tgt IN (SELECT entity_id FROM kept)""")
def graph_subgraph_assembled(d: Data) -> DataFrame:
    nodes, edges, cut = graph.subgraph(d.kg_nodes, d.kg_edges, "region", 2, 40, "induced")
    a = nodes.select(F.lit("node").alias("kind"), F.col("entity_id").alias("a"), F.lit("").alias("b"))
    return a.unionByName(edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("tgt").alias("b"))).withColumn("is_truncated", F.lit(cut))
