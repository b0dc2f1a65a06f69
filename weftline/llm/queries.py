"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, chosen_path, decontaminate, hard_negatives, jaccard_join, language_id, mixing, prefix_trie, repeats, telephony, token_file, url_filter, warc_archive
from .common import Scratch, literal_rows, table

#: The rules of the url query.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = literal_rows(spark, RULES, "rule string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "warc").path("archive")
    warc_archive.write_archive(table(spark, sf_dir, "pages"), path)
    return warc_archive.digest(warc_archive.read_archive(spark, path))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language_id.learn(docs.filter(~held_out).select("text", "lang"))
    return language_id.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = decontaminate.decontaminate(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), "contaminated")


def byte_bpe() -> str:
    """The public byte-level vocabulary's file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "tokens").path("ids")
    token_file.write_tokens(table(spark, sf_dir, "documents"), path, byte_bpe())
    return token_file.read_tokens(spark, path)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = literal_rows(spark, [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_format.digest(chat_format.format_conversations(chat_format.conversation_events(rows)))


def op10_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "telephony").path("audio")
    telephony.write_audio(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return telephony.read_stored(spark, path)


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_classes(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.build(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.col("label").cast("bigint")
    rows = hard_negatives.scaled(vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)))
    return hard_negatives.mine(rows, rows.filter(F.col("vec_id") % 100 == 0))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_jaccard_join, op3_warc_archive, op4_language_id, op5_repeats, op6_decontaminate, op7_token_ids, op8_mixing, op9_chat_format, op10_telephony, op11_minhash_dedup, op12_prefix_trie, op13_hard_negatives)}

_URL_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(rule, rhost, rpath, verdict) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
  ('net/de/', 'net', '/de/', 'block'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
f AS (SELECT page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC) AS k
      FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM p LEFT JOIN f ON p.page_id = f.page_id AND f.k = 1
"""

_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, url, b, octet_length(b) AS n, sha1(b) AS digest, max(page_id) OVER (PARTITION BY sha256(b)) AS owner, chr(13) || chr(10) AS nl FROM p),
t AS (SELECT *, CASE WHEN n >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS kind FROM d),
r AS (SELECT *, encode('WARC/1.1' || nl || 'WARC-Type: ' || kind || nl || 'WARC-Record-ID: <urn:page:' || page_id || '>' || nl
        || 'WARC-Date: 1970-01-01T00:00:00Z' || nl || 'WARC-Target-URI: ' || replace(replace(url, chr(13), '%0D'), chr(10), '%0A') || nl
        || 'WARC-Payload-Digest: sha1:' || digest || nl
        || CASE WHEN kind = 'revisit' THEN 'WARC-Refers-To: <urn:page:' || owner || '>' || nl
             || 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' || nl || 'Content-Length: 0' || nl
           ELSE 'Content-Length: ' || n || nl END || nl) || CASE WHEN kind = 'revisit' THEN ''::BLOB ELSE b END || encode(nl || nl) AS record FROM t)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, kind AS record_type,
       CASE WHEN kind = 'revisit' THEN owner END AS refers_to, CAST(octet_length(record) AS BIGINT) AS record_bytes, sha256(record) AS record_sha256
FROM r
"""

_CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, '<s>' || role || chr(10) || regexp_replace(text, '(</?s>|\[/?INST\])', '\\\1', 'g') || chr(10) || '</s>' || chr(10) AS piece FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(piece)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_LEAK_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM iw WHERE len(w) > 0)),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw),
m AS (SELECT DISTINCT pos.doc_id, pos.i, ks.k, array_to_string(pos.w[pos.i:pos.i + ks.k - 1], ' ') AS s
      FROM pos JOIN (SELECT DISTINCT k FROM win) ks ON pos.i + ks.k - 1 <= len(pos.w)),
f AS (SELECT m.doc_id, m.i, m.k, win.item_id FROM m JOIN win ON m.k = win.k AND m.s = win.s),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM f) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM f) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_NEAR_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM t WHERE len(w) > 0)),
k AS (SELECT doc_id, count(*) AS n, sha256(string_agg(s, chr(10) ORDER BY s)) AS of FROM s GROUP BY doc_id),
c AS (SELECT *, min(doc_id) OVER (PARTITION BY of) AS cls FROM k),
cs AS (SELECT s.doc_id AS cls, c.n, s.s FROM s JOIN c ON s.doc_id = c.doc_id AND c.doc_id = c.cls),
link AS (SELECT a.cls AS a, b.cls AS b FROM cs a JOIN cs b ON a.s = b.s AND a.cls <> b.cls
         GROUP BY a.cls, b.cls, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT t.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(least(c.cls, least_of.b), t.doc_id) AS BIGINT) AS component_id
FROM t LEFT JOIN c ON t.doc_id = c.doc_id LEFT JOIN least_of ON least_of.a = c.cls
"""

_PATHS_SQL = (
    _NEAR_SQL.replace("least(len(w), 5)", "least(len(w), 2)").replace("len(w) - 5", "len(w) - 2").replace(">= 75 *", ">= 80 *")
    .replace("AS component_id\n", "AS component_id, CAST(coalesce(least(c.cls, least_of.b), t.doc_id) AS BIGINT) = t.doc_id AS kept\n")
)

_REPEATS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
part AS (SELECT doc_id, o, substr(h, 2 * o + 1, 2 * 599) AS h FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 99, 0), 500)) AS o FROM d)),
win AS (SELECT doc_id, o + i AS i, md5_number(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, o, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM part)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
isl AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run
        FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM dup)),
run AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM isl GROUP BY doc_id, run),
cut AS (SELECT doc_id, count(*) AS n, sum(b - a) AS gone FROM run GROUP BY doc_id),
ends AS (SELECT doc_id, a, b FROM run UNION ALL SELECT doc_id, len(h) // 2, len(h) // 2 FROM d),
gap AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS p FROM ends),
kept AS (SELECT gap.doc_id, sha256(unhex(string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a))) AS sha FROM gap JOIN d USING (doc_id) GROUP BY gap.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, kept.sha AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_TRIE_SQL = """
WITH RECURSIVE src AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), substr(sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
crc(conv_id, x, s, left_over) AS (
  SELECT DISTINCT conv_id, CAST(4294967295 AS BIGINT), 0, CAST(conv_id AS VARCHAR) FROM src
  UNION ALL SELECT conv_id, CASE WHEN s = 0 THEN xor(x, ascii(left_over)) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END,
    (s + 1) % 9, CASE WHEN s = 8 THEN substr(left_over, 2) ELSE left_over END FROM crc WHERE left_over <> ''),
h AS (SELECT conv_id AS c, xor(x, 4294967295) % 9 AS h, conv_id - conv_id % 5 AS base FROM crc WHERE left_over = ''),
r AS (SELECT c, 0 AS part, pos, role, text FROM h JOIN src ON src.conv_id = h.base AND pos < h
      UNION ALL SELECT c, 1, pos, role, text FROM h JOIN src ON src.conv_id = h.c AND pos >= h),
p AS (SELECT c, row_number() OVER w AS d, octet_length(encode(text)) AS b, list(struct_pack(role := role, text := text)) OVER w AS path FROM r WINDOW w AS (PARTITION BY c ORDER BY part, pos)),
k AS (SELECT c, d, b, sha256(CAST(to_json(path) AS VARCHAR)) AS k FROM p
      UNION ALL SELECT c, 0, 0, '' FROM h),
m AS (SELECT c, d, b, k, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, max(d) OVER (PARTITION BY c) AS n FROM k),
v AS (SELECT k, d, min(up) AS up, min(c) AS conv_id, count(*) AS n_convs, max(n) AS n, min(b) AS b, string_agg(c, ',' ORDER BY c) FILTER (d = n) AS ids FROM m GROUP BY k, d),
below AS (SELECT a.k, count(*) FILTER (leaf) AS n_leaves, sum((n_convs - 1) * b) AS saved
          FROM (SELECT DISTINCT x.k, y.k AS u FROM m x JOIN m y ON x.c = y.c AND y.d >= x.d) a JOIN (SELECT *, d = n AS leaf FROM v) z ON z.k = a.u GROUP BY a.k)
SELECT v.conv_id, v.d AS depth, o.conv_id AS parent_conv_id, v.n_convs, (SELECT count(*) FROM v z WHERE z.up = v.k) AS n_children, below.n_leaves,
       CAST(below.saved AS BIGINT) AS saved_tokens, sha256(coalesce(v.ids, '')) AS ends_sha256
FROM v JOIN below USING (k) LEFT JOIN v o ON o.k = v.up
"""

_NEGATIVES_SQL = """
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND (a.label <> b.label OR a.vec_id <> b.vec_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON p.k <= 5 AND s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

ORACLE_SQL = {
    "op1_url_filter": _URL_SQL, "op2_jaccard_join": _NEAR_SQL, "op3_warc_archive": _WARC_SQL, "op5_repeats": _REPEATS_SQL, "op6_decontaminate": _LEAK_SQL,
    "op9_chat_format": _CHAT_SQL, "op11_minhash_dedup": _PATHS_SQL, "op12_prefix_trie": _TRIE_SQL, "op13_hard_negatives": _NEGATIVES_SQL,
}
