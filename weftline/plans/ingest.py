"""Queries of ingest: chunking, parsing, merging and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text, tokens
from ..operators import chunking, context, extract, merge
from .views import Data, register

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = register(QUERIES, SQL)

_WORDS = "list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> '')"


def _words(c: str) -> str:
    return _WORDS.replace("{c}", c)


@query(f"""WITH t AS (SELECT full_doc_id, file_path, {_words('content')} AS w FROM {{distinct_docs}}),
l AS (SELECT *, CAST(greatest(0, floor((len(w) - 21) / 180)) AS INT) AS last FROM t WHERE len(w) > 0),
r AS (SELECT *, unnest(range(0, last + 1)) AS i FROM l),
o AS (SELECT full_doc_id, CAST(i AS INT) AS chunk_order_index, CASE WHEN i = last AND len(w) - (i * 180 + 180) BETWEEN 1 AND 20 THEN list_concat(w[i * 180 + 1:i * 180 + 200], w[i * 180 + 181:]) ELSE w[i * 180 + 1:i * 180 + 200] END AS own FROM r)
SELECT full_doc_id, chunk_order_index, 'chunk--' || md5(array_to_string(own, ' ')) AS id, CAST(len(own) AS INT) AS tokens FROM o""")
def chunk_sliding(d: Data) -> DataFrame:
    return chunking.sliding(d.distinct_docs, 200, 20).select("full_doc_id", "chunk_order_index", "id", "tokens")


@query(f"""WITH p AS (SELECT full_doc_id, string_split(content, chr(10)) AS s FROM {{distinct_docs}}),
q AS (SELECT full_doc_id, i - 1 AS piece, s[i] AS c, {_words('s[i]')} AS w FROM (SELECT full_doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM p) x),
r AS (SELECT *, unnest(CASE WHEN len(w) > 30 THEN range(0, len(w), 25) ELSE [0] END) AS start FROM q),
o AS (SELECT full_doc_id, piece, start, CASE WHEN len(w) <= 30 THEN c ELSE array_to_string(w[start + 1:start + 30], ' ') END AS t, len(CASE WHEN len(w) <= 30 THEN w ELSE w[start + 1:start + 30] END) AS n FROM r)
SELECT full_doc_id, CAST(piece AS INT) AS piece, CAST(start AS INT) AS start, 'chunk--' || md5(t) AS id, CAST(n AS INT) AS tokens FROM o""")
def chunk_by_separator(d: Data) -> DataFrame:
    return chunking.by_separator(d.distinct_docs, "\n", 30, 5).select("full_doc_id", "piece", "start", "id", "tokens")


@query("SELECT conv_id, count(*) AS n, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS messages FROM {conversations} GROUP BY conv_id")
def chat_history(d: Data) -> DataFrame:
    rows = context.chat_history(d.conversations, ["conv_id"])
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n")
    return rows.select("conv_id", F.size("messages").cast("bigint").alias("n"), F.md5(said).alias("messages"))


_PARSE = """l AS (SELECT chunk_id, list_filter(string_split(response, chr(10)), lambda x: x <> '') AS s FROM {responses}),
k AS (SELECT chunk_id, CASE WHEN list_position(s, '<|COMPLETE|>') > 0 THEN s[1:list_position(s, '<|COMPLETE|>') - 1] ELSE s END AS s FROM l),
f AS (SELECT chunk_id, i, string_split(s[i], '<|#|>') AS f FROM (SELECT chunk_id, s, unnest(range(1, len(s) + 1)) AS i FROM k) x)"""
_CLEAN = "trim(regexp_replace(translate({c}, '\"''', ''), '\\s+', ' ', 'g'))"


@query(f"""WITH {_PARSE} SELECT chunk_id, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY i) - 1 AS INT) AS ord, {_CLEAN.replace('{c}', 'f[2]')} AS name, lower(replace({_CLEAN.replace('{c}', 'f[3]')}, ' ', '')) AS type, trim(regexp_replace(f[4], '\\s+', ' ', 'g')) AS description
FROM f WHERE len(f) >= 4 AND f[1] = 'entity'""")
def extract_parse(d: Data) -> DataFrame:
    return extract.parse_entities(d.responses, ["chunk_id"]).select("chunk_id", "ord", "name", "type", "description")


@query(f"""WITH {_PARSE} SELECT chunk_id, {_CLEAN.replace('{c}', 'f[2]')} AS source_id, {_CLEAN.replace('{c}', 'f[3]')} AS target_id, {_CLEAN.replace('{c}', 'f[4]')} AS keywords, trim(f[5]) AS description, coalesce(TRY_CAST(translate(f[6], '"', '') AS FLOAT), 1.0)::DOUBLE AS weight
FROM f WHERE len(f) >= 5 AND f[1] = 'relation'""")
def extract_parse_relations(d: Data) -> DataFrame:
    return extract.parse_relations(d.responses, ["chunk_id"]).select("chunk_id", "source_id", "target_id", "keywords", "description", F.col("weight").cast("double").alias("weight"))


@query("""SELECT c.chunk_id, r.chunk_id IS NOT NULL AS cached, CASE WHEN r.chunk_id IS NOT NULL THEN md5(r.response) END AS response FROM {text_chunks} c LEFT JOIN {responses} r USING (chunk_id)""")
def extract_cache_probe(d: Data) -> DataFrame:
    hits, misses = extract.probe_cache(d.text_chunks, d.responses)
    return hits.select("chunk_id", F.lit(True).alias("cached"), F.md5("response").alias("response")).unionByName(misses.select("chunk_id", F.lit(False).alias("cached"), F.lit(None).cast("string").alias("response")))


@query("""SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'a, ' || CAST(item_id AS VARCHAR) WHEN 1 THEN 'c' ELSE '' END AS high, CASE item_id % 4 WHEN 0 THEN 'b' ELSE '' END AS low FROM {benchmark}""")
def keywords_parse(d: Data) -> DataFrame:
    said = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit('```json\n{"high_level_keywords":["a","","'), F.col("item_id").cast("string"), F.lit('"],"low_level_keywords":["b"]}\n```')))
    said = said.when(F.col("item_id") % 4 == 1, '{"high_level_keywords":["c"],"low_level_keywords":[]}').when(F.col("item_id") % 4 == 2, '{"high_level_keywords":["c"]}').otherwise("no json")
    rows = d.benchmark.select("item_id", extract.parse_keywords(said).alias("k"))
    return rows.select("item_id", F.array_join("k.high", ", ").alias("high"), F.array_join("k.low", ", ").alias("low"))


@query(f"SELECT doc_id, CAST(len({_words('text')}) AS INT) AS tokens FROM {{documents}}")
def token_count(d: Data) -> DataFrame:
    return d.documents.select("doc_id", tokens.token_count(F.col("text")).alias("tokens"))


@query(f"SELECT source, CAST(sum(len({_words('text')})) AS BIGINT) AS tokens, round(sum(length(text)) / sum(len({_words('text')})), 6) AS chars_per_token FROM {{documents}} GROUP BY source")
def token_stats(d: Data) -> DataFrame:
    n = tokens.token_count(F.col("text")).cast("bigint")
    return d.documents.groupBy("source").agg(F.sum(n).alias("tokens"), F.round(F.sum(F.char_length("text")) / F.sum(n), 6).alias("chars_per_token"))


_ORDERED = "(chunk_ord::BIGINT * 10000000000 + ord)"
_VOTE = f"""v AS (SELECT name, type, {_ORDERED} AS o FROM {{entity_facts}} WHERE trim(type) <> '' UNION ALL SELECT entity_id, entity_type, 99999999999999999 FROM {{old_nodes}}),
vc AS (SELECT name, type, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, min(o)) AS r FROM v GROUP BY name, type),
vote AS (SELECT n.name, coalesce(vc.type, 'UNKNOWN') AS entity_type FROM (SELECT DISTINCT name FROM {{entity_facts}}) n LEFT JOIN vc ON vc.name = n.name AND r = 1)"""
_DESC = f"""df AS (SELECT *, row_number() OVER (PARTITION BY name, description ORDER BY {_ORDERED}) AS r FROM {{entity_facts}} WHERE trim(description) <> ''),
dl AS (SELECT name, list(description ORDER BY timestamp, -length(description), {_ORDERED}) AS parts FROM df WHERE r = 1 GROUP BY name)"""


@query(f"WITH {_VOTE} SELECT * FROM vote")
def entity_type_vote(d: Data) -> DataFrame:
    return merge.type_vote(d.entity_facts, d.old_nodes)


@query(f"WITH {_DESC} SELECT name, array_to_string(parts, '|') AS descriptions FROM dl")
def description_order(d: Data) -> DataFrame:
    return merge.ordered_descriptions(d.entity_facts, ["name"]).select("name", F.array_join("descriptions", "|").alias("descriptions"))


@query(f"WITH {_DESC} SELECT name, array_to_string(parts, '<SEP>') AS description, len(parts) > 1 AND (len(parts) >= 8 OR list_sum(list_transform(parts, lambda p: len({_words('p')}))) >= 1200) AS due FROM dl")
def description_join(d: Data) -> DataFrame:
    said, due = merge.join_descriptions(F.col("descriptions"))
    return merge.ordered_descriptions(d.entity_facts, ["name"]).select("name", said.alias("description"), due.alias("due"))


@query(f"""WITH RECURSIVE {_DESC},
g(name, i, done, cur, n) AS (SELECT name, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST(0 AS BIGINT) FROM dl
 UNION ALL SELECT g.name, i + 1, CASE WHEN n + t > 12 AND len(cur) = 1 THEN list_append(done, cur[1] || '+' || x) WHEN n + t > 12 AND len(cur) > 1 THEN list_append(done, array_to_string(cur, '+')) ELSE done END,
  CASE WHEN n + t > 12 AND len(cur) = 1 THEN CAST([] AS VARCHAR[]) WHEN n + t > 12 AND len(cur) > 1 THEN [x] ELSE list_append(cur, x) END,
  CASE WHEN n + t > 12 AND len(cur) = 1 THEN 0 WHEN n + t > 12 AND len(cur) > 1 THEN t ELSE n + t END
 FROM g JOIN (SELECT name, k, parts[k] AS x, len({_words('parts[k]')}) AS t FROM (SELECT name, parts, unnest(range(1, len(parts) + 1)) AS k FROM dl) y) q ON q.name = g.name AND q.k = g.i + 1),
f AS (SELECT g.name, CASE WHEN len(cur) > 0 THEN list_append(done, array_to_string(cur, '+')) ELSE done END AS all_ FROM g JOIN dl USING (name) WHERE g.i = len(dl.parts))
SELECT name, CAST(len(all_) AS INT) AS n_groups, array_to_string(all_, '|') AS groups FROM f""")
def description_groups(d: Data) -> DataFrame:
    groups = merge.description_groups(F.col("descriptions"), 12)
    rows = merge.ordered_descriptions(d.entity_facts, ["name"]).withColumn("g", groups)
    return rows.select("name", F.size("g").alias("n_groups"), F.array_join(F.transform("g", lambda g: F.array_join(g, "+")), "|").alias("groups"))


def _first_distinct(parts: str) -> str:
    return f"list_filter({parts}, lambda x, i: list_position({parts}, x) = i)"


_OLD_IDS = "coalesce(string_split(o.source_id, '<SEP>'), [])"
_MERGED = f"""{_VOTE}, {_DESC},
g AS (SELECT name, list(source_id ORDER BY {_ORDERED}) AS ids, list(file_path ORDER BY {_ORDERED}) AS paths FROM {{entity_facts}} GROUP BY name),
c AS (SELECT g.name, v.entity_type, list_concat({_OLD_IDS}, g.ids) AS ids, list_concat(list_filter(coalesce(string_split(o.file_path, '<SEP>'), []), lambda x: NOT starts_with(x, '...truncated...')), g.paths) AS paths,
  list_concat(coalesce(string_split(o.description, '<SEP>'), []), coalesce(dl.parts, [])) AS parts FROM g JOIN vote v USING (name) LEFT JOIN dl USING (name) LEFT JOIN {{old_nodes}} o ON o.entity_id = g.name),
m AS (SELECT name, entity_type, {_first_distinct('ids')} AS ids, {_first_distinct('paths')} AS paths, {_first_distinct('parts')} AS parts FROM c WHERE len(parts) > 0)"""


@query(f"""WITH {_MERGED} SELECT name AS entity_id, entity_type, array_to_string(parts, '<SEP>') AS description, array_to_string(CASE WHEN len(ids) > 6 THEN ids[-6:] ELSE ids END, '<SEP>') AS source_id,
CASE WHEN len(ids) > 6 THEN 'FIFO 6/' || CAST(len(ids) AS VARCHAR) ELSE '' END AS truncate, array_to_string(CASE WHEN len(paths) > 2 THEN list_append(paths[-2:], '...truncated...(FIFO)') ELSE paths END, '<SEP>') AS file_path, 'ent--' || md5(name) AS id FROM m""")
def merge_entities_incremental(d: Data) -> DataFrame:
    return merge.merge_entities(d.entity_facts, d.old_nodes, 6, "FIFO", 2).select("entity_id", "entity_type", "description", "source_id", "truncate", "file_path", "id")


_FRESH = _MERGED.replace("UNION ALL SELECT entity_id, entity_type, 99999999999999999 FROM {old_nodes}", "").replace("ON o.entity_id = g.name", "ON false")


@query(f"""WITH {_FRESH} SELECT name AS entity_id, entity_type, md5(name || chr(10) || array_to_string(parts, '<SEP>')) AS content, array_to_string(CASE WHEN len(ids) > 4 THEN ids[1:4] ELSE ids END, '<SEP>') AS source_id,
CASE WHEN len(ids) > 4 THEN 'KEEP Old' ELSE '' END AS truncate, array_to_string(CASE WHEN len(paths) > 1 THEN list_append(paths[1:1], '...truncated...(KEEP Old)') ELSE paths END, '<SEP>') AS file_path FROM m""")
def merge_entities(d: Data) -> DataFrame:
    return merge.merge_entities(d.entity_facts, None, 4, "keep", 1).select("entity_id", "entity_type", F.md5("content").alias("content"), "source_id", "truncate", "file_path")


_REL = f"""r AS (SELECT least(source_id, target_id) AS src, greatest(source_id, target_id) AS tgt, keywords, description, weight, source_chunk_id, file_path, timestamp, {_ORDERED} AS o FROM {{relation_facts}} WHERE source_id <> target_id),
w AS (SELECT src, tgt, string_agg(DISTINCT trim(x), ',' ORDER BY trim(x)) AS keywords FROM (SELECT src, tgt, unnest(string_split(keywords, ',')) AS x FROM r) y WHERE trim(x) <> '' GROUP BY src, tgt),
d1 AS (SELECT *, row_number() OVER (PARTITION BY src, tgt, description ORDER BY o) AS k FROM r),
dd AS (SELECT src, tgt, list(description ORDER BY timestamp, -length(description), o) AS parts FROM d1 WHERE k = 1 GROUP BY src, tgt),
ri AS (SELECT src, tgt, list(source_chunk_id ORDER BY o) AS ids, sum(weight::DOUBLE) AS weight FROM r GROUP BY src, tgt),
rm AS (SELECT src, tgt, keywords, parts, {_first_distinct('ids')} AS ids, weight FROM ri JOIN w USING (src, tgt) JOIN dd USING (src, tgt))"""


@query(f"WITH {_REL} SELECT src, tgt, keywords, array_to_string(parts, '<SEP>') AS description, round(weight, 3) AS weight, array_to_string(CASE WHEN len(ids) > 5 THEN ids[-5:] ELSE ids END, '<SEP>') AS source_id, 'rel--' || md5(src || tgt) AS id FROM rm")
def merge_relations(d: Data) -> DataFrame:
    return merge.merge_relations(d.relation_facts, None, 5).select("src", "tgt", "keywords", "description", F.round("weight", 3).alias("weight"), "source_id", "id")


@query("""WITH e AS (SELECT src, tgt, source_id, description, file_path, unnest([src, tgt]) AS entity_id FROM {tree_edges} WHERE src < 'nation:2'),
m AS (SELECT * FROM e WHERE entity_id NOT IN (SELECT entity_id FROM {kg_nodes} WHERE entity_type = 'customer'))
SELECT entity_id, 'UNKNOWN' AS entity_type, (SELECT string_agg(description, '<SEP>' ORDER BY o) FROM (SELECT description, min((src, tgt)) AS o FROM m m2 WHERE m2.entity_id = q.entity_id GROUP BY description) x) AS description,
(SELECT string_agg(source_id, '<SEP>' ORDER BY o) FROM (SELECT source_id, min((src, tgt)) AS o FROM m m2 WHERE m2.entity_id = q.entity_id GROUP BY source_id) x) AS source_id FROM (SELECT DISTINCT entity_id FROM m) q""")
def merge_missing_endpoints(d: Data) -> DataFrame:
    edges = d.tree_edges.filter("src < 'nation:2'")
    return merge.missing_endpoints(edges, d.kg_nodes.filter("entity_type = 'customer'")).select("entity_id", "entity_type", "description", "source_id")


@query("""WITH e AS (SELECT src, tgt, source_id, description, unnest([src, tgt]) AS entity_id FROM {kg_edges}),
m AS (SELECT * FROM e WHERE entity_id NOT IN (SELECT entity_id FROM {kg_nodes} WHERE entity_type = 'customer')),
d AS (SELECT entity_id, string_agg(description, '<SEP>' ORDER BY o) AS description FROM (SELECT entity_id, description, min((src, tgt)) AS o FROM m GROUP BY 1, 2) x GROUP BY 1),
s AS (SELECT entity_id, string_agg(source_id, '<SEP>' ORDER BY o) AS source_id FROM (SELECT entity_id, source_id, min((src, tgt)) AS o FROM m GROUP BY 1, 2) x GROUP BY 1)
SELECT entity_id, 'UNKNOWN' AS entity_type, description, source_id FROM d JOIN s USING (entity_id)""")
def merge_missing_endpoints_all(d: Data) -> DataFrame:
    # merge_missing_endpoints over the whole graph: its own SQL sees a part of the edges only.
    return merge.missing_endpoints(d.kg_edges, d.kg_nodes.filter("entity_type = 'customer'")).select("entity_id", "entity_type", "description", "source_id")


_STORE = "SELECT 'rel--' || md5(CASE WHEN k % 2 = 0 THEN src || tgt ELSE tgt || src END) AS id, k FROM (SELECT src, tgt, row_number() OVER (ORDER BY src, tgt) AS k FROM {tree_edges}) x"


@query(f"WITH s AS ({_STORE}), r AS (SELECT src, tgt FROM {{tree_edges}} WHERE keywords = 'lives in'), g AS (SELECT 'rel--' || md5(src || tgt) AS id FROM r UNION SELECT 'rel--' || md5(tgt || src) FROM r) SELECT id, id IN (SELECT id FROM g) AS removed FROM s")
def merge_relation_vector_replace(d: Data) -> DataFrame:
    store = d.spark.sql(_STORE, tree_edges=d.tree_edges)
    return merge.stale_relation_vectors(store, d.tree_edges.filter("keywords = 'lives in'")).select("id", F.col("stale").alias("removed"))


_STORE_ALL = "SELECT 'rel--' || md5(CASE WHEN length(src || tgt) % 2 = 0 THEN src || tgt ELSE tgt || src END) AS id FROM {kg_edges}"


@query(f"WITH s AS ({_STORE_ALL}), r AS (SELECT src, tgt FROM {{kg_edges}} WHERE keywords = 'ships'), g AS (SELECT 'rel--' || md5(src || tgt) AS id FROM r UNION SELECT 'rel--' || md5(tgt || src) FROM r) SELECT id, id IN (SELECT id FROM g) AS removed FROM s")
def merge_relation_vector_replace_all(d: Data) -> DataFrame:
    # merge_relation_vector_replace over the whole graph, the edges that its own SQL leaves out among them.
    store = d.spark.sql(_STORE_ALL, kg_edges=d.kg_edges)
    return merge.stale_relation_vectors(store, d.kg_edges.filter("keywords = 'ships'")).select("id", F.col("stale").alias("removed"))


@query("""SELECT name, source_id, count(*) AS n FROM {entity_facts} f WHERE (name, source_id) IN (SELECT name, source_id FROM {entity_facts} WHERE ord % 2 = 0) OR (name, source_id) IN (SELECT entity_id, 'd60' FROM {old_nodes}) GROUP BY 1, 2""")
def merge_keep_filter(d: Data) -> DataFrame:
    allowed = d.entity_facts.filter("ord % 2 = 0").select("name", F.col("source_id").alias("chunk_id"))
    known = d.old_nodes.select(F.col("entity_id").alias("name"), F.lit("d60").alias("chunk_id"))
    return merge.keep_filter(d.entity_facts, allowed, known).groupBy("name", "source_id").agg(F.count("*").alias("n"))


@query(f"WITH x AS (SELECT entity_id, list_filter(list_concat(string_split(source_id, '<SEP>'), ['d1', '', 'd2']), lambda v: v <> '') AS s FROM {{kg_nodes}}) SELECT entity_id, array_to_string({_first_distinct('s')}, ',') AS ids FROM x")
def source_ids_merge(d: Data) -> DataFrame:
    new = F.array(F.lit("d1"), F.lit(""), F.lit("d2"))
    return d.kg_nodes.select("entity_id", F.array_join(merge.union_ids(text.unpack(F.col("source_id")), new), ",").alias("ids"))


@query("""WITH x AS (SELECT entity_id, string_split(source_id, '<SEP>') AS s FROM {kg_nodes}) SELECT entity_id, array_to_string(s[-2:], ',') AS fifo, array_to_string(s[1:2], ',') AS keep, 'FIFO 2/' || CAST(len(s) AS VARCHAR) AS fifo_info, 'KEEP Old' AS keep_info, '' AS none FROM x""")
def source_ids_limit(d: Data) -> DataFrame:
    s = text.unpack(F.col("source_id"))
    return d.kg_nodes.select(
        "entity_id", F.array_join(merge.limit_ids(s, 2), ",").alias("fifo"), F.array_join(merge.limit_ids(s, 2, "keep"), ",").alias("keep"), merge.truncation_info(s, 2).alias("fifo_info"),
        merge.truncation_info(s, 2, "KEEP").alias("keep_info"), F.array_join(merge.limit_ids(s, 0), ",").alias("none"),
    )


@query("""SELECT target_id, string_agg(DISTINCT trim(x), ',' ORDER BY trim(x)) AS keywords FROM (SELECT target_id, unnest(string_split(keywords, ',')) AS x FROM {relation_facts}) y WHERE trim(x) <> '' GROUP BY target_id""")
def keyword_merge(d: Data) -> DataFrame:
    return d.relation_facts.groupBy("target_id").agg(merge.merge_keywords(F.collect_set("keywords")).alias("keywords"))


@query(f"""WITH x AS (SELECT entity_id, list_filter(list_concat(string_split(file_path, '<SEP>'), ['f0.md', 'f1.md', 'f2.md']), lambda p: NOT starts_with(p, '...truncated...')) AS p FROM {{old_nodes}}), y AS (SELECT entity_id, {_first_distinct('p')} AS p FROM x)
SELECT entity_id, array_to_string(list_append(p[-2:], '...truncated...(FIFO)'), '<SEP>') AS file_path FROM y""")
def file_path_limit(d: Data) -> DataFrame:
    new = F.array(F.lit("f0.md"), F.lit("f1.md"), F.lit("f2.md"))
    return d.old_nodes.select("entity_id", text.pack(merge.limit_paths(text.unpack(F.col("file_path")), new, 2)).alias("file_path"))


@query("""WITH p AS (SELECT DISTINCT full_doc_id, least(source_id, target_id) AS src, greatest(source_id, target_id) AS tgt FROM {relation_facts} WHERE source_id <> target_id),
n AS (SELECT full_doc_id, name FROM {entity_facts} UNION SELECT full_doc_id, src FROM p UNION SELECT full_doc_id, tgt FROM p)
SELECT full_doc_id, CAST(count(*) AS INT) AS n_entities, md5(string_agg(name, ',' ORDER BY name)) AS entity_names, CAST((SELECT count(*) FROM p WHERE p.full_doc_id = n.full_doc_id) AS INT) AS n_relations FROM n GROUP BY full_doc_id""")
def doc_entity_index(d: Data) -> DataFrame:
    return merge.document_index(d.entity_facts, d.relation_facts).select("full_doc_id", "n_entities", F.md5(F.array_join("entity_names", ",")).alias("entity_names"), "n_relations")


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[\\x{10000}-\\x{10FFFF}\\x{FFFE}\\x{FFFF}]', '', 'g'), '\\s+', ' ', 'g'))) AS clean, md5(trim(translate(regexp_replace(regexp_replace(text, '[\\x{10000}-\\x{10FFFF}]', '', 'g'), '\\s+', ' ', 'g'), '\"''', ''))) AS bare FROM {documents}")
def sanitize_text(d: Data) -> DataFrame:
    return d.documents.select("doc_id", F.md5(text.sanitize(F.col("text"))).alias("clean"), F.md5(text.sanitize(F.col("text"), True)).alias("bare"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS summary FROM {documents}")
def content_summary(d: Data) -> DataFrame:
    return d.documents.select("doc_id", text.summary(F.col("text")).alias("summary"))


@query("SELECT doc_id, 'doc--' || md5(text) AS id, md5(coalesce(lang, '') || '|' || coalesce(source, '')) AS args, 'rel--' || md5(lang || source) AS rel FROM {documents}")
def md5_ids(d: Data) -> DataFrame:
    return d.documents.select("doc_id", ids.prefixed_md5("doc-", F.col("text")).alias("id"), ids.args_md5(F.col("lang"), F.col("source")).alias("args"), ids.relation_id(F.col("lang"), F.col("source")).alias("rel"))


@query("""WITH h AS (SELECT entity_id, sha256('kg' || entity_id) AS h FROM {kg_nodes})
SELECT entity_id, h[7:8] || h[5:6] || h[3:4] || h[1:2] || h[11:12] || h[9:10] || h[15:16] || '4' || h[14:14] || substr('89ab', strpos('0123456789abcdef', h[17:17]) - 1 - 4 * ((strpos('0123456789abcdef', h[17:17]) - 1) // 4) + 1, 1) || h[18:32] AS uuid,
CAST(('0x' || h[15:16] || '4' || h[14:14] || h[11:12] || h[9:10] || h[7:8] || h[5:6] || h[3:4] || h[1:2])::UBIGINT AS VARCHAR) AS number FROM h""")
def point_id(d: Data) -> DataFrame:
    return d.kg_nodes.select("entity_id", ids.point_uuid("kg", F.col("entity_id")).alias("uuid"), ids.point_id("kg", F.col("entity_id")).alias("number"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(regexp_extract(url, '(?i)^https?://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1), ''), 'unknown') AS file_name FROM {pages}")
def extract_file_name(d: Data) -> DataFrame:
    return d.pages.select("page_id", text.file_name(F.col("url")).alias("file_name"))


@query("SELECT o_orderkey, 'my_file_' || CAST(o_orderkey AS VARCHAR) || '_' || strftime(o_orderdate, '%Y%m%d%H%M%S') || '_' || left(sha256(CAST(o_orderkey AS VARCHAR)), 8) || '.md' AS name FROM {orders}")
def upload_name(d: Data) -> DataFrame:
    name = F.concat(F.lit("my file ("), F.col("o_orderkey").cast("string"), F.lit(").md"))
    return d.orders.select("o_orderkey", text.upload_name(F.regexp_replace(name, r" \(", "_("), F.col("o_orderdate"), F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("name"))


@query("""SELECT o_orderkey, CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B' WHEN b < 1048576 THEN regexp_replace(regexp_replace(printf('%.2f', round(b / 1024.0, 2)), '0+$', ''), '\\.$', '') || ' KB'
WHEN b < 1073741824 THEN regexp_replace(regexp_replace(printf('%.2f', round(b / 1048576.0, 2)), '0+$', ''), '\\.$', '') || ' MB' ELSE regexp_replace(regexp_replace(printf('%.2f', round(b / 1073741824.0, 2)), '0+$', ''), '\\.$', '') || ' GB' END AS size
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey WHEN 1 THEN o_orderkey * 1024 WHEN 2 THEN o_orderkey * 100000 ELSE o_orderkey * 1073741824 END AS b FROM {orders}) x""")
def format_file_size(d: Data) -> DataFrame:
    k = F.col("o_orderkey")
    b = F.when(k % 4 == 0, k).when(k % 4 == 1, k * 1024).when(k % 4 == 2, k * 100000).otherwise(k * 1073741824)
    return d.orders.select("o_orderkey", text.format_file_size(b).alias("size"))


@query("SELECT task_id, CASE WHEN status = 'Processing' THEN CASE current_stage WHEN 'MergingEntities' THEN 'Merging Entities' ELSE 'Persisting' END ELSE status END AS said FROM {tasks}")
def task_status_text(d: Data) -> DataFrame:
    return d.tasks.select("task_id", text.status_text(F.col("status"), F.col("current_stage")).alias("said"))
