"""Many questions at once: every vector whose id is divisible by 100 asks, and each question keeps its own lists, quotas and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import canonical
from ..operators import context, graph, retrieve, vector
from ..session import settle
from .views import Data, register

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = register(QUERIES, SQL)

BY = ("question_id",)
TOP_K, TOP_CHUNKS = 20, 10
ENTITY_TOKENS, RELATION_TOKENS, CHUNK_TOKENS = 120, 300, 6000

_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _hits_sql(store: str, columns: str, k: int) -> str:
    return f"""SELECT question_id, {columns}, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) - 1 AS INT) AS pos
  FROM (SELECT q.vec_id AS question_id, e.vec_id, {columns}, {_COS} AS score FROM {store} e, (SELECT * FROM {{embeddings}} WHERE vec_id % 100 = 0) q) x WHERE score >= 0.2 QUALIFY pos < {k}"""


def _rr_sql(lists: list[str], key: str, columns: str) -> str:
    union = " UNION ALL ".join(f"SELECT question_id, {columns}, pos, {i} AS l FROM {name}" for i, name in enumerate(lists))
    return f"""SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY opos, l) - 1 AS INT) AS pos, {columns}
  FROM (SELECT question_id, {columns}, pos AS opos, l, row_number() OVER (PARTITION BY question_id, {key} ORDER BY pos, l) AS k FROM ({union}) u) v WHERE k = 1"""


_EC, _RC = "entity_id, entity_type, description, source_id, rank", "src, tgt, keywords, description, source_id, weight, rank"
_LISTS = f"""deg AS MATERIALIZED (SELECT x AS entity_id, count(*) AS degree FROM (SELECT src AS x FROM {{kg_edges}} UNION ALL SELECT tgt FROM {{kg_edges}}) u GROUP BY x),
eh AS MATERIALIZED ({_hits_sql("{ent_vec}", "entity_id", TOP_K)}), rh AS MATERIALIZED ({_hits_sql("{rel_vec}", "src, tgt", TOP_K)}),
le AS MATERIALIZED (SELECT eh.question_id, eh.pos, n.entity_id, n.entity_type, n.description, n.source_id, coalesce(degree, 0) AS rank FROM eh JOIN {{kg_nodes}} n USING (entity_id) LEFT JOIN deg USING (entity_id)),
np AS MATERIALIZED (SELECT DISTINCT question_id, src, tgt FROM (SELECT question_id, e.src, e.tgt FROM le JOIN {{kg_edges}} e ON e.src = le.entity_id UNION ALL SELECT question_id, e.src, e.tgt FROM le JOIN {{kg_edges}} e ON e.tgt = le.entity_id) x),
lr AS MATERIALIZED (SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY rank DESC, weight DESC, src, tgt) - 1 AS INT) AS pos, {_RC} FROM (
  SELECT np.question_id, e.*, coalesce(a.degree, 0) + coalesce(b.degree, 0) AS rank FROM np JOIN {{kg_edges}} e USING (src, tgt) LEFT JOIN deg a ON a.entity_id = e.src LEFT JOIN deg b ON b.entity_id = e.tgt) x),
gr AS MATERIALIZED (SELECT rh.question_id, rh.pos, rh.src, rh.tgt, e.keywords, e.description, e.source_id, e.weight, CAST(0 AS BIGINT) AS rank FROM rh JOIN {{kg_edges}} e ON e.src = least(rh.src, rh.tgt) AND e.tgt = greatest(rh.src, rh.tgt)),
ge AS MATERIALIZED (SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY nth) - 1 AS INT) AS pos, n.entity_id, n.entity_type, n.description, n.source_id, CAST(0 AS BIGINT) AS rank
  FROM (SELECT question_id, entity_id, min(nth) AS nth FROM (SELECT question_id, src AS entity_id, pos * 2 AS nth FROM gr UNION ALL SELECT question_id, tgt, pos * 2 + 1 FROM gr) x GROUP BY ALL) f JOIN {{kg_nodes}} n USING (entity_id)),
me AS MATERIALIZED ({_rr_sql(["le", "ge"], "entity_id", _EC)}), mr AS MATERIALIZED ({_rr_sql(["lr", "gr"], "least(src, tgt), greatest(src, tgt)", _RC)})"""


def _asked(d: Data) -> DataFrame:
    return d.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), "embedding")


def _hits(d: Data, store: DataFrame, k: int, *columns: str) -> DataFrame:
    found = vector.top_k_batch(store, _asked(d), k, vector="embedding", tie="vec_id", query_id="question_id")
    return settle(found.join(store.select("vec_id", *columns), "vec_id").select("question_id", "pos", *columns), "hits", False)


def _lists(d: Data) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of every question, merged from the local and the global search.

    The graph is gone through twice, whatever the number of lists: for the edges that the hits name, and for the degrees of their ends.
    """
    e, r = ["question_id", "pos", *_EC.split(", ")], ["question_id", "pos", *_RC.split(", ")]
    of_entities, of_relations = _hits(d, d.ent_vec, TOP_K, "entity_id"), _hits(d, d.rel_vec, TOP_K, "src", "tgt")
    near = settle(_named(d.kg_edges, of_entities, of_relations), "edges", False)
    degrees = settle(graph.degrees(d.kg_edges, near.select(F.explode(F.array("src", "tgt")).alias("entity_id"))), "degrees", False)
    local = settle(retrieve.local_entities(of_entities, d.kg_nodes, degrees=degrees, by=BY).select(e), "entities", False)
    at = settle(retrieve.local_relations(local, near, degrees=degrees, by=BY).select(r), "relations", False)
    found = settle(retrieve.global_relations(of_relations, near, BY).select(r), "found", False)
    ends = retrieve.global_entities(found, d.kg_nodes, BY).select(e)
    return settle(retrieve.merge_entities(local, ends, BY), "entities", False), settle(retrieve.merge_relations(at, found, BY), "relations", False)


def _named(edges: DataFrame, entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges at the entities (entity_id) or of the pairs (src, tgt), in one pass over the edges. Both lists are stored and short beside the edges."""
    low, high = canonical(F.col("src"), F.col("tgt"))
    ids, asked = entities.select("entity_id").distinct(), pairs.select(low.alias("src"), high.alias("tgt")).distinct()
    marked = edges.join(ids.select(F.col("entity_id").alias("src"), F.lit(True).alias("__src")), "src", "left")
    marked = marked.join(ids.select(F.col("entity_id").alias("tgt"), F.lit(True).alias("__tgt")), "tgt", "left")
    marked = marked.join(asked.withColumn("__pair", F.lit(True)), ["src", "tgt"], "left")
    return marked.filter("__src OR __tgt OR __pair").select(edges.columns)


@query(f"WITH {_LISTS} SELECT question_id, 'entity' AS kind, pos, entity_id AS a, '' AS b, rank FROM me UNION ALL SELECT question_id, 'relation', pos, src, tgt, rank FROM mr")
def mix_search_batch(d: Data) -> DataFrame:
    entities, relations = _lists(d)
    row = lambda kind, df, a, b: df.select("question_id", F.lit(kind).alias("kind"), F.col("pos").cast("int").alias("pos"), a.alias("a"), b.alias("b"), F.col("rank").cast("bigint").alias("rank"))
    return row("entity", entities, F.col("entity_id"), F.lit("")).unionByName(row("relation", relations, F.col("src"), F.col("tgt")))


def _polling_sql(items: str, p: str, exclude: str = "", owner: str = "question_id, item, chunk_id", most: int = 5) -> str:
    return f"""{p}named AS MATERIALIZED (SELECT question_id, pos AS item, nth, s[nth] AS chunk_id FROM (SELECT question_id, pos, string_split(source_id, '<SEP>') AS s, unnest(range(1, len(string_split(source_id, '<SEP>')) + 1)) AS nth FROM {items}) x {exclude}),
{p}cnt AS (SELECT question_id, chunk_id, count(*) AS n FROM {p}named GROUP BY ALL),
{p}once AS (SELECT question_id, item, nth, chunk_id FROM {p}named QUALIFY row_number() OVER (PARTITION BY {owner} ORDER BY item, nth) = 1),
{p}k AS MATERIALIZED (SELECT question_id, item, chunk_id, row_number() OVER (PARTITION BY question_id, item ORDER BY n DESC, nth) AS k FROM {p}once JOIN {p}cnt USING (question_id, chunk_id)),
{p}size AS (SELECT question_id, item, count(*) AS size, row_number() OVER (PARTITION BY question_id ORDER BY item) - 1 AS i, count(*) OVER (PARTITION BY question_id) AS items FROM {p}k GROUP BY question_id, item),
{p}quota AS (SELECT *, CASE WHEN items = 1 THEN {most} ELSE CAST(round_even({most} - i::DOUBLE / (items - 1) * {most - 1}, 0) AS INT) END AS quota FROM {p}size),
{p}open AS MATERIALIZED (SELECT *, sum(greatest(0, quota - size)) OVER (PARTITION BY question_id) AS spare FROM {p}quota),
{p}late AS (SELECT question_id, i, k, chunk_id FROM {p}k JOIN {p}open USING (question_id, item) WHERE k > quota AND items > 1 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY i, k) <= min(spare) OVER (PARTITION BY question_id)),
{p}all AS (SELECT question_id, 0 AS rnd, i, k, chunk_id FROM {p}k JOIN {p}open USING (question_id, item) WHERE k <= quota UNION ALL SELECT question_id, 1, i, k, chunk_id FROM {p}late),
{p}first AS (SELECT question_id, rnd, i, k, chunk_id FROM {p}all QUALIFY row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY rnd, i, k) = 1),
{p}c AS MATERIALIZED (SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY rnd, i, k) - 1 AS INT) AS pos, t.* FROM {p}first JOIN {{text_chunks}} t USING (chunk_id))"""


def _budget_sql(text: str, source: str, budget: int) -> str:
    return f"SELECT * EXCLUDE (upto) FROM (SELECT *, sum(len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda x: x <> ''))) OVER (PARTITION BY question_id ORDER BY pos) AS upto FROM {source}) b WHERE upto <= {budget}"


_CHUNKS = f"""{_LISTS}, {_polling_sql("me", "e")}, {_polling_sql("mr", "r", "WHERE (question_id, s[nth]) NOT IN (SELECT (question_id, chunk_id) FROM ec)", "question_id, chunk_id")},
vh AS MATERIALIZED ({_hits_sql("(SELECT 'd' || CAST(vec_id AS STRING) AS chunk_id, embedding, vec_id FROM {embeddings})", "chunk_id", TOP_CHUNKS)}),
vc AS (SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY pos) - 1 AS INT) AS pos, chunk_id, content, file_path FROM vh JOIN {{text_chunks}} USING (chunk_id)),
mc AS MATERIALIZED ({_rr_sql(["vc", "ec", "rc"], "chunk_id", "chunk_id, content, file_path")}), bc AS MATERIALIZED ({_budget_sql("content", "mc", CHUNK_TOKENS)}),
refs AS MATERIALIZED (SELECT question_id, file_path, CAST(row_number() OVER (PARTITION BY question_id ORDER BY n DESC, first) AS VARCHAR) AS reference_id
  FROM (SELECT question_id, file_path, count(*) AS n, min(pos) AS first FROM bc WHERE file_path <> '' AND file_path <> 'unknown_source' GROUP BY ALL) x)"""


def _chunks(d: Data) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(entities, relations, references, chunks) of every question."""
    entities, relations = _lists(d)
    own = settle(retrieve.related_chunks_entities(entities, d.text_chunks, by=BY), "chunks", False)
    further = settle(retrieve.related_chunks_relations(relations, d.text_chunks, own, by=BY), "chunks", False)
    store = d.embeddings.withColumn("chunk_id", F.concat(F.lit("d"), F.col("vec_id").cast("string")))
    near = settle(retrieve.with_content(_hits(d, store, TOP_CHUNKS, "chunk_id"), d.text_chunks, BY), "chunks", False)
    merged = settle(retrieve.merge_chunks(near, own, further, BY), "chunks", False)
    refs, chunks = retrieve.references(settle(retrieve.token_budget(merged, F.col("content"), CHUNK_TOKENS, by=BY), "chunks", False), BY)
    return entities, relations, refs, chunks


@query(f"WITH {_CHUNKS} SELECT b.question_id, b.pos, b.chunk_id, md5(content) AS content, b.file_path, coalesce(r.reference_id, '') AS reference_id FROM bc b LEFT JOIN refs r USING (question_id, file_path)")
def retrieve_context_batch(d: Data) -> DataFrame:
    return _chunks(d)[3].select("question_id", "pos", "chunk_id", F.md5("content").alias("content"), "file_path", "reference_id")


_ELINE = "entity_id || ' (' || entity_type || '): ' || description"
_RLINE = "src || ' -> ' || tgt || ': ' || keywords || ' - ' || description"


def _context_sql() -> str:
    fence = lambda title, body: f"'{title}:' || chr(10) || chr(10) || '```' || chr(10) || ({body}) || chr(10) || '```'"
    own = "WHERE x.question_id = q.question_id"
    t = context.TITLES
    parts = [fence(t[0], f"SELECT string_agg({_ELINE}, chr(10) ORDER BY pos) FROM be x {own}"), fence(t[1], f"SELECT string_agg({_RLINE}, chr(10) ORDER BY pos) FROM br x {own}")]
    parts += [fence(t[2], f"SELECT string_agg('[' || file_path || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY pos) FROM bc x {own}"), fence(t[3], f"SELECT string_agg('[' || file_path || '] ' || file_path, chr(10) ORDER BY CAST(reference_id AS INT)) FROM refs x {own}")]
    some = " UNION ".join(f"SELECT question_id FROM {x}" for x in ("be", "br", "bc"))
    return f"WITH {_CHUNKS}, be AS MATERIALIZED ({_budget_sql(_ELINE, 'me', ENTITY_TOKENS)}), br AS MATERIALIZED ({_budget_sql(_RLINE, 'mr', RELATION_TOKENS)}) SELECT q.question_id, md5(concat_ws(chr(10) || chr(10), {', '.join(parts)})) AS context FROM ({some}) q"


@query(_context_sql())
def context_string_batch(d: Data) -> DataFrame:
    entities, relations, refs, chunks = _chunks(d)
    entities = retrieve.token_budget(entities, context.entity_line(), ENTITY_TOKENS, by=BY)
    relations = retrieve.token_budget(relations, context.relation_line(), RELATION_TOKENS, by=BY)
    return context.context_string(entities, relations, chunks, refs, BY).select("question_id", F.md5("context").alias("context"))
