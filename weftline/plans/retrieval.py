"""Queries of retrieval: searches, merges of ranked lists, chunk choice, budgets, references and context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import models
from ..operators import context, retrieve, vector
from ..session import settle
from .stores import query_vector
from .views import Data, register

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = register(QUERIES, SQL)

_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _hit_sql(store: str, columns: str, vec_id: int, k: int) -> str:
    return f"SELECT CAST(row_number() OVER (ORDER BY {_COS} DESC, e.vec_id) - 1 AS INT) AS pos, {columns} FROM {{{store}}} e, (SELECT embedding FROM {{embeddings}} WHERE vec_id = {vec_id}) q WHERE {_COS} >= 0.2 ORDER BY {_COS} DESC, e.vec_id LIMIT {k}"


_DEG = "deg AS (SELECT x AS entity_id, count(*) AS degree FROM (SELECT src AS x FROM {kg_edges} UNION ALL SELECT tgt FROM {kg_edges}) u GROUP BY x)"
_LOCAL = f"""eh AS ({_hit_sql("ent_vec", "entity_id", 0, 20)}), {_DEG},
le AS (SELECT eh.pos, n.entity_id, n.entity_type, n.description, n.source_id, coalesce(degree, 0) AS rank FROM eh JOIN {{kg_nodes}} n USING (entity_id) LEFT JOIN deg USING (entity_id)),
lr AS (SELECT CAST(row_number() OVER (ORDER BY rank DESC, weight DESC, src, tgt) - 1 AS INT) AS pos, * FROM (
  SELECT e.src, e.tgt, e.keywords, e.description, e.source_id, e.weight, coalesce(a.degree, 0) + coalesce(b.degree, 0) AS rank
  FROM {{kg_edges}} e LEFT JOIN deg a ON a.entity_id = e.src LEFT JOIN deg b ON b.entity_id = e.tgt WHERE e.src IN (SELECT entity_id FROM le) OR e.tgt IN (SELECT entity_id FROM le)) x)"""
_GLOBAL = f"""rh AS MATERIALIZED ({_hit_sql("rel_vec", "src, tgt", 1, 20)}),
gr AS MATERIALIZED (SELECT rh.pos, rh.src, rh.tgt, e.keywords, e.description, e.source_id, e.weight, CAST(0 AS BIGINT) AS rank FROM rh JOIN {{kg_edges}} e ON e.src = least(rh.src, rh.tgt) AND e.tgt = greatest(rh.src, rh.tgt)),
ge AS (SELECT CAST(row_number() OVER (ORDER BY nth) - 1 AS INT) AS pos, n.entity_id, n.entity_type, n.description, n.source_id, CAST(0 AS BIGINT) AS rank
  FROM (SELECT entity_id, min(nth) AS nth FROM (SELECT src AS entity_id, pos * 2 AS nth FROM gr UNION ALL SELECT tgt, pos * 2 + 1 FROM gr) x GROUP BY entity_id) f JOIN {{kg_nodes}} n USING (entity_id))"""


def _rr_sql(lists: list[str], key: str, columns: str) -> str:
    union = " UNION ALL ".join(f"SELECT {columns}, pos, {i} AS l FROM {name}" for i, name in enumerate(lists))
    return f"SELECT CAST(row_number() OVER (ORDER BY opos, l) - 1 AS INT) AS pos, {columns} FROM (SELECT {columns}, pos AS opos, l, row_number() OVER (PARTITION BY {key} ORDER BY pos, l) AS k FROM ({union}) u) v WHERE k = 1"


_PAIR = "least(src, tgt), greatest(src, tgt)"
_EC, _RC = "entity_id, entity_type, description, source_id, rank", "src, tgt, keywords, description, source_id, weight, rank"
_MIX = f"""{_LOCAL}, {_GLOBAL}, me AS ({_rr_sql(["le", "ge"], "entity_id", _EC)}), mr AS ({_rr_sql(["lr", "gr"], _PAIR, _RC)})"""


def _local(d: Data) -> tuple[DataFrame, DataFrame]:
    hits = vector.top_k(d.ent_vec, query_vector(d), 20, vector="embedding", tie="vec_id").select("pos", "entity_id")
    entities = settle(retrieve.local_entities(settle(hits, "hits"), d.kg_nodes, d.kg_edges), "entities")
    return entities, retrieve.local_relations(entities, d.kg_edges)


def _global(d: Data) -> tuple[DataFrame, DataFrame]:
    hits = vector.top_k(d.rel_vec, query_vector(d, 1), 20, vector="embedding", tie="vec_id").select("pos", "src", "tgt")
    relations = settle(retrieve.global_relations(settle(hits, "hits"), d.kg_edges), "relations")
    return retrieve.global_entities(relations, d.kg_nodes), relations


_E, _R = ["pos", "entity_id", "entity_type", "description", "rank"], ["pos", "src", "tgt", "keywords", "weight", "rank"]


@query(f"WITH {_LOCAL} SELECT {', '.join(_E)} FROM le")
def local_entities(d: Data) -> DataFrame:
    return _local(d)[0].select(_E)


@query(f"WITH {_LOCAL} SELECT {', '.join(_R)} FROM lr")
def local_relations(d: Data) -> DataFrame:
    return _local(d)[1].select(_R)


@query(f"WITH {_GLOBAL} SELECT {', '.join(_R)} FROM gr")
def global_relations(d: Data) -> DataFrame:
    return _global(d)[1].select(_R)


@query(f"WITH {_GLOBAL} SELECT {', '.join(_E)} FROM ge")
def global_entities(d: Data) -> DataFrame:
    return _global(d)[0].select(_E)


def _listed(entities: DataFrame, relations: DataFrame) -> DataFrame:
    a = entities.select(F.lit("entity").alias("kind"), F.col("pos").cast("int").alias("pos"), F.col("entity_id").alias("a"), F.lit("").alias("b"), F.col("rank").cast("bigint").alias("rank"))
    return a.unionByName(relations.select(F.lit("relation").alias("kind"), F.col("pos").cast("int").alias("pos"), F.col("src").alias("a"), F.col("tgt").alias("b"), F.col("rank").cast("bigint").alias("rank")))


def _listed_sql(e: str, r: str) -> str:
    return f"SELECT 'entity' AS kind, pos, entity_id AS a, '' AS b, rank FROM {e} UNION ALL SELECT 'relation', pos, src, tgt, rank FROM {r}"


@query(f"WITH {_LOCAL} {_listed_sql('le', 'lr')}")
def local_search(d: Data) -> DataFrame:
    return _listed(*_local(d))


@query(f"WITH {_GLOBAL} {_listed_sql('ge', 'gr')}")
def global_search(d: Data) -> DataFrame:
    return _listed(*_global(d))


def _mix(d: Data) -> tuple[DataFrame, DataFrame]:
    (le, lr), (ge, gr) = _local(d), _global(d)
    e, r = _EC.split(", "), _RC.split(", ")
    return retrieve.merge_entities(le.select("pos", *e), ge.select("pos", *e)), retrieve.merge_relations(lr.select("pos", *r), gr.select("pos", *r))


@query(f"WITH {_MIX} {_listed_sql('me', 'mr')}")
def mix_search(d: Data) -> DataFrame:
    return _listed(*_mix(d))


@query(_rr_sql(["{rank_a}", "{rank_b}"], "entity_id", "entity_id, description"))
def rr_merge_entities(d: Data) -> DataFrame:
    return retrieve.merge_entities(d.rank_a, d.rank_b).select("pos", "entity_id", "description")


@query(_rr_sql(["{rank_rel_a}", "{rank_rel_b}"], _PAIR, "src, tgt, keywords"))
def rr_merge_relations(d: Data) -> DataFrame:
    return retrieve.merge_relations(d.rank_rel_a, d.rank_rel_b).select("pos", "src", "tgt", "keywords")


@query(_rr_sql(["{rank_chunk}", "{rank_chunk_b}", "{rank_chunk_c}"], "chunk_id", "chunk_id, file_path"))
def rr_merge_chunks(d: Data) -> DataFrame:
    return retrieve.merge_chunks(d.rank_chunk, d.rank_chunk_b, d.rank_chunk_c).select("pos", "chunk_id", "file_path")


@query("SELECT chunk_id, count(*) AS n FROM (SELECT unnest(string_split(source_id, '<SEP>')) AS chunk_id FROM {kg_nodes}) x GROUP BY chunk_id")
def chunk_occurrence(d: Data) -> DataFrame:
    return retrieve.chunk_occurrence(d.kg_nodes)


def _polling_sql(items: str, prefix: str, exclude: str = "", owner: str = "PARTITION BY item, chunk_id", most: int = 5) -> str:
    """Quotas and leftovers; the last CTE is {prefix}chosen (pos, chunk_id)."""
    return f"""{prefix}named AS (SELECT pos AS item, nth, s[nth] AS chunk_id FROM (SELECT pos, string_split(source_id, '<SEP>') AS s, unnest(range(1, len(string_split(source_id, '<SEP>')) + 1)) AS nth FROM {items}) x {exclude}),
{prefix}cnt AS (SELECT chunk_id, count(*) AS n FROM {prefix}named GROUP BY chunk_id),
{prefix}once AS (SELECT item, nth, chunk_id FROM (SELECT *, row_number() OVER ({owner} ORDER BY item, nth) AS r FROM {prefix}named) x WHERE r = 1),
{prefix}k AS (SELECT item, chunk_id, row_number() OVER (PARTITION BY item ORDER BY n DESC, nth) AS k FROM {prefix}once JOIN {prefix}cnt USING (chunk_id)),
{prefix}size AS (SELECT item, count(*) AS size, row_number() OVER (ORDER BY item) - 1 AS i, count(*) OVER () AS items FROM {prefix}k GROUP BY item),
{prefix}quota AS (SELECT *, CASE WHEN items = 1 THEN {most} ELSE CAST(round_even({most} - i::DOUBLE / (items - 1) * {most - 1}, 0) AS INT) END AS quota FROM {prefix}size),
{prefix}spare AS (SELECT sum(greatest(0, quota - size)) AS spare FROM {prefix}quota),
{prefix}late AS (SELECT i, k, chunk_id FROM (SELECT *, row_number() OVER (ORDER BY i, k) AS turn FROM {prefix}k JOIN {prefix}quota USING (item) WHERE k > quota AND items > 1) x WHERE turn <= (SELECT spare FROM {prefix}spare)),
{prefix}all AS (SELECT 0 AS rnd, i, k, chunk_id FROM {prefix}k JOIN {prefix}quota USING (item) WHERE k <= quota UNION ALL SELECT 1, i, k, chunk_id FROM {prefix}late),
{prefix}chosen AS (SELECT CAST(row_number() OVER (ORDER BY rnd, i, k) - 1 AS INT) AS pos, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY rnd, i, k) AS r FROM {prefix}all) x WHERE r = 1)"""


@query(f"WITH {_polling_sql('{rank_ent}', 'a')} SELECT pos, chunk_id FROM achosen")
def weighted_polling(d: Data) -> DataFrame:
    return retrieve.weighted_polling(retrieve.item_chunks(d.rank_ent, "source_id"), 5).select("pos", "chunk_id")


_E_CHUNKS = f"""{_polling_sql("{rank_ent}", "a")}, ec AS (SELECT CAST(row_number() OVER (ORDER BY c.pos) - 1 AS INT) AS pos, t.* FROM achosen c JOIN {{text_chunks}} t USING (chunk_id))"""
_R_CHUNKS = f"""{_polling_sql("{rank_rel_a}", "b", "WHERE s[nth] NOT IN (SELECT chunk_id FROM ec)", "PARTITION BY chunk_id")}, rc AS (SELECT CAST(row_number() OVER (ORDER BY c.pos) - 1 AS INT) AS pos, t.* FROM bchosen c JOIN {{text_chunks}} t USING (chunk_id))"""


def _entity_chunks(d: Data) -> DataFrame:
    return settle(retrieve.related_chunks_entities(settle(d.rank_ent, "ranked"), d.text_chunks), "chunks")


def _relation_chunks(d: Data) -> DataFrame:
    return retrieve.related_chunks_relations(settle(d.rank_rel_a, "ranked"), d.text_chunks, _entity_chunks(d))


@query(f"WITH {_E_CHUNKS} SELECT pos, chunk_id, md5(content) AS content, file_path FROM ec")
def related_chunks_entities(d: Data) -> DataFrame:
    return _entity_chunks(d).select("pos", "chunk_id", F.md5("content").alias("content"), "file_path")


@query(f"WITH {_E_CHUNKS}, {_R_CHUNKS} SELECT pos, chunk_id, md5(content) AS content, file_path FROM rc")
def related_chunks_relations(d: Data) -> DataFrame:
    return _relation_chunks(d).select("pos", "chunk_id", F.md5("content").alias("content"), "file_path")


_VC = "SELECT 'd' || CAST(vec_id AS STRING) AS chunk_id, embedding, vec_id FROM {embeddings}"


@query(f"WITH e AS ({_VC}), h AS (SELECT CAST(row_number() OVER (ORDER BY {_COS} DESC, e.vec_id) - 1 AS INT) AS hpos, e.chunk_id FROM e, (SELECT embedding FROM {{embeddings}} WHERE vec_id = 2) q WHERE {_COS} >= 0.2 ORDER BY {_COS} DESC, e.vec_id LIMIT 20) SELECT CAST(row_number() OVER (ORDER BY hpos) - 1 AS INT) AS pos, chunk_id, md5(content) AS content, file_path FROM h JOIN {{text_chunks}} USING (chunk_id)")
def chunks_vector(d: Data) -> DataFrame:
    store = d.spark.sql(_VC, embeddings=d.embeddings)
    hits = vector.top_k(store, query_vector(d, 2), 20, vector="embedding", tie="vec_id").select("pos", "chunk_id")
    return retrieve.with_content(hits, d.text_chunks).select("pos", "chunk_id", F.md5("content").alias("content"), "file_path")


@query("""WITH q AS (SELECT list_distinct(regexp_extract_all(lower('The Thing that is and of inthan erer'), '\\w+')) AS w),
s AS (SELECT chunk_id, file_path, len(list_intersect(q.w, list_distinct(regexp_extract_all(lower(content), '[\\pL\\pN_]+')))) / len(q.w) AS score FROM {rank_chunk_c}, q)
SELECT CAST(row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS INT) AS pos, chunk_id, round(score, 6) AS score FROM s ORDER BY score DESC, chunk_id LIMIT 10""")
def rerank_chunks(d: Data) -> DataFrame:
    score = models.rerank_column(models.OverlapReranker(), "The Thing that is and of inthan erer")
    rows = d.rank_chunk_c.withColumn("score", score(F.col("content"))).drop("pos").orderBy(F.desc("score"), "chunk_id").limit(10)
    return retrieve.ranked(rows, F.desc("score"), "chunk_id").select("pos", "chunk_id", F.round("score", 6).alias("score"))


def _budget_sql(text: str, source: str, columns: str, budget: int) -> str:
    return f"SELECT {columns} FROM (SELECT *, sum(len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda x: x <> ''))) OVER (ORDER BY pos) AS s FROM {source}) b WHERE s <= {budget}"


_ELINE = "entity_id || ' (' || entity_type || '): ' || description"
_RLINE = "src || ' -> ' || tgt || ': ' || keywords || ' - ' || description"


@query(_budget_sql(_ELINE, "{rank_ent}", "pos, entity_id", 60))
def token_budget_entities(d: Data) -> DataFrame:
    return retrieve.token_budget(d.rank_ent, context.entity_line(), 60).select("pos", "entity_id")


@query(_budget_sql(_RLINE, "{rank_rel_a}", "pos, src, tgt", 90))
def token_budget_relations(d: Data) -> DataFrame:
    return retrieve.token_budget(d.rank_rel_a, context.relation_line(), 90).select("pos", "src", "tgt")


@query(_budget_sql("content", "{rank_chunk_c}", "pos, chunk_id", 3000))
def token_budget_chunks(d: Data) -> DataFrame:
    return retrieve.token_budget(d.rank_chunk_c, F.col("content"), 3000).select("pos", "chunk_id")


_REFS = "refs AS (SELECT CAST(row_number() OVER (ORDER BY n DESC, first) AS VARCHAR) AS reference_id, file_path FROM (SELECT file_path, count(*) AS n, min(pos) AS first FROM {chunks} WHERE file_path <> '' AND file_path <> 'unknown_source' GROUP BY file_path) x)"


@query(f"WITH {_REFS.replace('{chunks}', '{rank_chunk}')} SELECT c.pos, c.chunk_id, coalesce(r.reference_id, '') AS reference_id, r.file_path FROM {{rank_chunk}} c LEFT JOIN refs r USING (file_path)")
def reference_list(d: Data) -> DataFrame:
    return retrieve.references(d.rank_chunk)[1].select("pos", "chunk_id", "reference_id", "file_path")


def _context_sql(e: str, r: str, c: str) -> str:
    t = context.TITLES
    fence = lambda title, body: f"'{title}:' || chr(10) || chr(10) || '```' || chr(10) || ({body}) || chr(10) || '```'"
    parts = [fence(t[0], f"SELECT string_agg({_ELINE}, chr(10) ORDER BY pos) FROM {e}"), fence(t[1], f"SELECT string_agg({_RLINE}, chr(10) ORDER BY pos) FROM {r}")]
    parts += [fence(t[2], f"SELECT string_agg('[' || file_path || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY pos) FROM {c}"), fence(t[3], "SELECT string_agg('[' || file_path || '] ' || file_path, chr(10) ORDER BY CAST(reference_id AS INT)) FROM refs")]
    return "SELECT md5(concat_ws(chr(10) || chr(10), " + ", ".join(parts) + ")) AS context"


@query(f"WITH {_REFS.replace('{chunks}', '{rank_chunk}')} {_context_sql('{rank_ent}', '{rank_rel_a}', '{rank_chunk}')}")
def context_string(d: Data) -> DataFrame:
    refs, chunks = retrieve.references(d.rank_chunk)
    return context.context_string(d.rank_ent, d.rank_rel_a, chunks, refs).select(F.md5("context").alias("context"))


_VCHUNKS = f"vc AS (SELECT CAST(row_number() OVER (ORDER BY h.pos) - 1 AS INT) AS pos, t.* FROM (SELECT CAST(row_number() OVER (ORDER BY {_COS} DESC, e.vec_id) - 1 AS INT) AS pos, 'd' || CAST(e.vec_id AS STRING) AS chunk_id FROM {{embeddings}} e, (SELECT embedding FROM {{embeddings}} WHERE vec_id = 2) q WHERE {_COS} >= 0.2 ORDER BY {_COS} DESC, e.vec_id LIMIT 20) h JOIN {{text_chunks}} t USING (chunk_id))"


def _contents(d: Data) -> DataFrame:
    store = d.spark.sql(_VC, embeddings=d.embeddings)
    near = retrieve.with_content(vector.top_k(store, query_vector(d, 2), 20, vector="embedding", tie="vec_id").select("pos", "chunk_id"), d.text_chunks)
    merged = retrieve.merge_chunks(settle(near, "chunks"), _entity_chunks(d), settle(_relation_chunks(d), "chunks"))
    return settle(retrieve.token_budget(merged, F.col("content"), 16000), "chunks")


_MERGED = f"""{_E_CHUNKS}, {_R_CHUNKS}, {_VCHUNKS}, mc AS ({_rr_sql(["vc", "ec", "rc"], "chunk_id", "chunk_id, content, file_path")}), bc AS ({_budget_sql("content", "mc", "pos, chunk_id, content, file_path", 16000)})"""


@query(f"WITH {_MERGED}, {_REFS.replace('{chunks}', 'bc')} SELECT b.pos, b.chunk_id, md5(content) AS content, b.file_path, coalesce(r.reference_id, '') AS reference_id FROM bc b LEFT JOIN refs r USING (file_path)")
def retrieve_context(d: Data) -> DataFrame:
    return retrieve.references(_contents(d))[1].select("pos", "chunk_id", F.md5("content").alias("content"), "file_path", "reference_id")


@query("SELECT mode, CASE WHEN mode = 'mix' THEN (SELECT count(*) > 0 FROM {rank_chunk}) ELSE FALSE END AS answers FROM (VALUES ('local'), ('global'), ('hybrid'), ('mix')) m(mode)")
def retrieve_empty_gate(d: Data) -> DataFrame:
    none = d.rank_ent.filter("false")
    rows = [(m, retrieve.empty_gate(none, d.rank_rel_a.filter("false"), d.rank_chunk, m)) for m in ("local", "global", "hybrid", "mix")]
    return d.spark.createDataFrame(rows, "mode string, answers boolean")


_DEFAULTS = "SELECT entity_id, CASE WHEN entity_type = 'customer' THEN NULL ELSE entity_type END AS entity_type, CASE WHEN length(description) % 2 = 0 THEN NULL ELSE description END AS description, CASE WHEN source_id < 'd2' THEN NULL ELSE file_path END AS file_path FROM {kg_nodes}"
_HITS = "SELECT CAST(vec_id AS INT) AS pos, entity_id, 'hit type' AS entity_type, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE 'hit ' || entity_id END AS description, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE 'hit.md' END AS file_path FROM {ent_vec}"


@query(f"""WITH n AS ({_DEFAULTS}), h AS ({_HITS}), {_DEG}
SELECT h.pos, h.entity_id, coalesce(n.entity_type, h.entity_type, '') AS entity_type, coalesce(n.description, h.description, '') AS description, coalesce(n.file_path, h.file_path) AS file_path, coalesce(degree, 0) AS rank
FROM h JOIN n USING (entity_id) LEFT JOIN deg USING (entity_id)""")
def entity_defaults(d: Data) -> DataFrame:
    """Hits whose nodes lack a description, a type or a path: those of the hit fill in."""
    nodes, hits = d.spark.sql(_DEFAULTS, kg_nodes=d.kg_nodes), d.spark.sql(_HITS, ent_vec=d.ent_vec)
    return retrieve.local_entities(hits, nodes, d.kg_edges).select("pos", "entity_id", "entity_type", "description", "file_path", "rank")
