"""Hand-computed cases."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline import plans
from weftline.operators import chunking, context, documents, extract, graph, kv, merge, retrieve, taskqueue, vector


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_kv(spark, tmp_path):
    store = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    keys = spark.createDataFrame([("b",), ("c",)], "id string")
    assert rows(kv.missing_keys(store, keys), "id") == [("c",)]
    assert rows(kv.get_by_ids(store, ["b", "x", "a", "b"]).orderBy("pos"), "pos", "id") == [(0, "b"), (2, "a"), (3, "b")]
    assert kv.is_empty(store).first()[0] is False and kv.is_empty(store.filter("false")).first()[0] is True
    new = spark.createDataFrame([("a", 5, 1), ("a", 6, 2), ("c", 7, 3)], "id string, v int, s int")
    assert sorted(rows(kv.upsert(store, new.select("id", "v", "s"), F.col("s")), "id", "v")) == [("a", 6), ("b", 2), ("c", 7)]
    for df in (store, store.filter("id = 'a'")):
        kv.replace_table(df, str(tmp_path / "t"))
    assert rows(spark.read.parquet(str(tmp_path / "t")), "id") == [("a",)]


def test_vector(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id int, vector array<float>")
    assert rows(vector.top_k(corpus, [1.0, 0.0], 5), "id", "pos") == [(1, 0), (2, 1)]
    asked = spark.createDataFrame([("q", [0.0, 2.0]), ("z", [0.0, 0.0])], "query_id string, vector array<float>")
    found = vector.top_k_batch(corpus, asked, 1)
    assert [(r["query_id"], r["id"], round(r["score"], 6)) for r in found.collect()] == [("q", 3, 1.0)]


def test_graph(spark):
    nodes = spark.createDataFrame([(x, "T1", "d", ["ws", "T1"]) for x in "abc"], "entity_id string, entity_type string, description string, labels array<string>")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0)], "src string, tgt string, weight double")
    pairs = spark.createDataFrame([("b", "a"), ("a", "c")], "src string, tgt string")
    assert sorted(rows(graph.edge_degrees(edges, edges), "src", "tgt", "rank")) == [("a", "b", 3), ("b", "c", 3)]
    assert rows(graph.edges_batch(edges, pairs), "src", "tgt", "weight") == [("b", "a", 1.0)]
    assert sorted(rows(graph.has_edge(edges, pairs), "src", "has_edge")) == [("a", False), ("b", True)]
    up = graph.upsert_nodes(nodes, spark.createDataFrame([("a", "T2"), ("z", None)], "entity_id string, entity_type string"))
    assert sorted((r["entity_id"], r["entity_type"], r["description"], tuple(r["labels"])) for r in up.collect() if r["entity_id"] in "az") == [("a", "T2", "d", ("ws", "T1", "T2")), ("z", None, None, ("Entity",))]
    n, e = graph.upsert_edges(nodes, edges, spark.createDataFrame([("b", "a", None), ("c", "x", 9.0)], "src string, tgt string, weight double"))
    assert sorted(rows(e, "src", "tgt", "weight")) == [("a", "b", 1.0), ("b", "c", 2.0), ("c", "x", 9.0)] and n.count() == 4
    n, e = graph.delete_nodes(nodes, edges, spark.createDataFrame([("a",)], "entity_id string"))
    assert n.count() == 2 and rows(e, "src", "tgt") == [("b", "c")]
    assert rows(graph.remove_edges(edges, pairs), "src", "tgt") == [("b", "c")]


def test_subgraph(spark):
    names = lambda s: spark.createDataFrame([(x, "t") for x in s], "entity_id string, entity_type string")
    path = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, tgt string")
    both = lambda pairs: {tuple(sorted(p)) for p in pairs}
    assert both(rows(graph.subgraph_pairs(names("abc"), path, "*", 2, 100), "start", "connected")) == {("a", "b"), ("b", "c"), ("a", "c")}
    triangle = path.union(spark.createDataFrame([("a", "c")], "src string, tgt string"))
    assert ("a", "a") in both(rows(graph.subgraph_pairs(names("abc"), triangle, "*", 3, 100), "start", "connected"))
    n, e, cut = graph.subgraph(names("abc"), path, "a", 2, 2, "induced")
    assert (n.count(), rows(e, "src", "tgt"), cut) == (2, [("a", "b")], True)
    with pytest.raises(ValueError):
        graph.subgraph_pairs(names("a"), path, "*", 6, 1)


def ranked(spark, names):
    return spark.createDataFrame([(i, x) for i, x in enumerate(names)], "pos int, entity_id string")


def test_round_robin(spark):
    merged = retrieve.merge_entities(ranked(spark, "xy"), ranked(spark, "yzw"))
    assert rows(merged.orderBy("pos"), "entity_id") == [("x",), ("y",), ("z",), ("w",)]


def polling(spark, items, most):
    chunks = [(i, c, k + 1) for i, cs in enumerate(items) for k, c in enumerate(cs)]
    return [r[0] for r in rows(retrieve.weighted_polling(spark.createDataFrame(chunks, "item int, chunk_id string, k int"), most).orderBy("pos"), "chunk_id")]


def test_weighted_polling(spark):
    assert polling(spark, ["ab", "cdef", "g"], 5) == list("abcdegf")
    assert polling(spark, ["abcdefgh"], 3) == list("abc")
    nine = [[f"{i}-{k}" for k in range(6)] for i in range(9)]
    got = polling(spark, nine, 5)
    assert [sum(c.startswith(f"{i}-") for c in got) for i in range(9)] == [5, 4, 4, 4, 3, 2, 2, 2, 1]


def poll(items, most):
    """The same by hand."""
    n = len(items)
    quota = [most] if n == 1 else [round(most - i / (n - 1) * (most - 1)) for i in range(n)]
    used = [min(q, len(c)) for q, c in zip(quota, items, strict=True)]
    out = [x for u, c in zip(used, items, strict=True) for x in c[:u]]
    for _ in range(sum(q - u for q, u in zip(quota, used, strict=True)) if n > 1 else 0):
        i = next((i for i in range(n) if used[i] < len(items[i])), None)
        if i is None:
            break
        out.append(items[i][used[i]])
        used[i] += 1
    return list(dict.fromkeys(out))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=6, unique=True), min_size=1, max_size=5), st.integers(1, 6))
def test_weighted_polling_property(spark, items, most):
    assert polling(spark, items, most) == poll(items, most)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 6), min_size=1, max_size=8), st.integers(0, 15))
def test_token_budget_property(spark, sizes, budget):
    list_ = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(sizes)], "pos int, t string")
    want, total = [], 0
    for i, n in enumerate(sizes):
        total += n
        if total > budget:
            break
        want.append((i,))
    assert rows(retrieve.token_budget(list_, F.col("t"), budget).orderBy("pos"), "pos") == want


def test_references(spark):
    chunks = spark.createDataFrame([(i, f"c{i}", p) for i, p in enumerate(["b", "a", "b", "unknown_source", ""])], "pos int, chunk_id string, file_path string")
    refs, numbered = retrieve.references(chunks)
    assert rows(refs.orderBy("reference_id"), "reference_id", "file_path") == [("1", "b"), ("2", "a")]
    assert rows(numbered.orderBy("pos"), "reference_id") == [("1",), ("2",), ("1",), ("",), ("",)]


def test_empty_gate(spark):
    none, some = spark.createDataFrame([], "pos int"), ranked(spark, "a")
    assert [retrieve.empty_gate(none, none, some, m) for m in ("mix", "hybrid", "local", "global")] == [True, False, False, False]
    assert retrieve.empty_gate(some, none, none, "local")


def test_chunk_sliding(spark):
    docs = lambda n: spark.createDataFrame([("d", "f", " ".join(f"t{i}" for i in range(n)))], "full_doc_id string, file_path string, content string")
    span = lambda df: [(c.split()[0], c.split()[-1], t) for c, t in rows(df.orderBy("chunk_order_index"), "content", "tokens")]
    assert span(chunking.sliding(docs(25), 10, 3)) == [("t0", "t9", 10), ("t7", "t16", 10), ("t14", "t23", 10), ("t21", "t24", 4)]
    tail = rows(chunking.sliding(docs(24), 10, 3).orderBy("chunk_order_index"), "content")
    assert len(tail) == 3 and tail[-1][0].split()[-4:] == ["t23", "t21", "t22", "t23"]
    assert chunking.sliding(docs(24), 10, 3, repeat_tail=False).count() == 3
    assert chunking.sliding(docs(0), 10, 3).count() == 0
    with pytest.raises(ValueError):
        chunking.sliding(docs(3), 3, 3)
    strict = chunking.by_separator(docs(12).withColumn("content", F.concat("content", F.lit("|x"))), "|", 10, 3, strict=True)
    with pytest.raises(Exception, match="a piece has 12 tokens"):
        strict.collect()


def test_extract(spark):
    said = 'entity<|#|>"Ann"<|#|>Big Org<|#|>d\nrelation<|#|>A<|#|>B<|#|>k<|#|>d<|#|>2.5\n<|COMPLETE|>\nentity<|#|>x<|#|>y<|#|>z'
    df = spark.createDataFrame([("c", said), ("n", None), ("e", "")], "chunk_id string, response string")
    assert rows(extract.parse_entities(df, ["chunk_id"]), "name", "type", "description") == [("Ann", "bigorg", "d")]
    assert rows(extract.parse_relations(df, ["chunk_id"]), "source_id", "target_id", "weight") == [("A", "B", 2.5)]
    keys = spark.createDataFrame([('```json\n{"high_level_keywords":["a",""],"low_level_keywords":["b"]}\n```',), ('{"high_level_keywords":["a"]}',), ("?",)], "r string").select(extract.parse_keywords(F.col("r")).alias("k"))
    assert rows(keys, "k.high", "k.low") == [(["a"], ["b"]), ([], []), ([], [])]


def array(spark, values):
    return spark.createDataFrame([(values,)], "a array<string>")


def test_limits(spark):
    five = array(spark, list("12345"))
    got = five.select(merge.limit_ids(F.col("a"), 3), merge.truncation_info(F.col("a"), 3), merge.limit_ids(F.col("a"), 3, "keep"), merge.truncation_info(F.col("a"), 3, "KEEP"), merge.limit_ids(F.col("a"), 0), merge.limit_ids(F.col("a"), 9)).first()
    assert tuple(got) == (list("345"), "FIFO 3/5", list("123"), "KEEP Old", [], list("12345"))
    paths = array(spark, ["x", "...truncated...(FIFO)"]).select(merge.limit_paths(F.col("a"), F.array(F.lit("y"), F.lit("z")), 2)).first()[0]
    assert paths == ["y", "z", "...truncated...(FIFO)"]
    assert array(spark, ["b, a", "a,c", None]).select(merge.merge_keywords(F.col("a"))).first()[0] == "a,b,c"


def test_description_groups(spark):
    parts = [" ".join("w" * n) for n in (7, 6, 3, 2, 5)]
    got = array(spark, parts).select(merge.description_groups(F.col("a"), 10)).first()[0]
    assert [[len(p.split()) for p in g] for g in got] == [[7, 6], [3, 2, 5]]


def facts(spark, values):
    return spark.createDataFrame([("e", t, d, f"c{i}", "f", ts, 0, i) for i, (t, d, ts) in enumerate(values)], "name string, type string, description string, source_id string, file_path string, timestamp bigint, chunk_ord int, ord int")


def test_merge_entities(spark):
    old = spark.createDataFrame([("e", "person", "old", "c9<SEP>c0", "g")], "entity_id string, entity_type string, description string, source_id string, file_path string")
    f = facts(spark, [("person", "bb", 2), ("org", "x", 1), ("org", "yyy", 1), ("person", "x", 3)])
    assert rows(merge.type_vote(f, old), "entity_type") == [("person",)]
    assert rows(merge.type_vote(f.filter("ord IN (1, 0)")), "entity_type") == [("person",)]
    assert rows(merge.ordered_descriptions(f, ["name"]), "descriptions") == [(["yyy", "x", "bb"],)]
    row = merge.merge_entities(f, old).first()
    assert (row["description"], row["source_id"], row["file_path"]) == ("old<SEP>yyy<SEP>x<SEP>bb", "c9<SEP>c0<SEP>c1<SEP>c2<SEP>c3", "g<SEP>f")
    again = merge.merge_entities(f.unionByName(f).dropDuplicates(["source_id", "ord"]), old).first()
    assert again == row
    assert merge.merge_entities(facts(spark, [("org", " ", 1)])).count() == 0


def test_merge_relations(spark):
    f = spark.createDataFrame([("b", "a", "k", "d1", 1.0, "c1", "f", 1, 0, 0), ("a", "b", "j,k", "d2", 1.5, "c2", "f", 2, 0, 1), ("a", "a", "k", "d", 1.0, "c", "f", 1, 0, 2)], "source_id string, target_id string, keywords string, description string, weight float, source_chunk_id string, file_path string, timestamp bigint, chunk_ord int, ord int")
    old = spark.createDataFrame([("a", "b", "z", "d0", 2.0, "c0", "g")], "src string, tgt string, keywords string, description string, weight double, source_id string, file_path string")
    row = merge.merge_relations(f, old).first()
    assert (row["src"], row["tgt"], row["weight"], row["keywords"], row["description"]) == ("a", "b", 4.5, "j,k,z", "d0<SEP>d1<SEP>d2")
    assert row["content"] == "j,k,z\ta\nb\nd0<SEP>d1<SEP>d2"


def test_missing_endpoints(spark):
    edges = spark.createDataFrame([("a", "b", "s1", "d", "f"), ("b", "c", "s2", "", "f")], "src string, tgt string, source_id string, description string, file_path string")
    ends = merge.missing_endpoints(edges, spark.createDataFrame([("a",)], "entity_id string"))
    assert sorted(rows(ends, "entity_id", "description", "source_id")) == [("b", "d", "s1<SEP>s2"), ("c", "c", "s2")]


def test_queue(spark):
    tasks = spark.createDataFrame([("a", 1, 1, "Pending"), ("b", 0, 3, "Pending"), ("c", 0, 2, "Pending"), ("d", 0, 1, "Processing")], "task_id string, priority int, created_at int, status string")
    assert rows(taskqueue.next_task(tasks), "task_id") == [("c",)]
    log = [("enqueue", 5), ("start", 0), ("progress", 40), ("delete", 0), ("fail", 0), ("retry", 0), ("reorder", 2), ("start", 0), ("complete", 0)]
    events = spark.createDataFrame([("t", i, op, arg) for i, (op, arg) in enumerate(log)], "task_id string, seq int, op string, arg int")
    at = lambda n: rows(taskqueue.fold_events(events.filter(F.col("seq") < n)), "status", "progress", "priority", "retries")[0]
    assert [at(n) for n in (1, 3, 4, 5, 6, 9)] == [("Pending", 0, 5, 0), ("Processing", 40, 5, 0), ("Processing", 40, 5, 0), ("Failed", 40, 5, 0), ("Pending", 0, 5, 1), ("Completed", 100, 2, 1)]


def test_progress(spark):
    e = spark.createDataFrame([("d", 1, "s1", 1, 3), ("d", 2, "s2", 0, 0)], "doc_id string, seq bigint, stage string, current bigint, total bigint")
    assert rows(taskqueue.progress(e), "stage", "progress") == [("s2", 33)]


def test_uploads(spark):
    f = spark.createDataFrame([(1, "a.md", bytearray(b"x")), (2, "a.md", bytearray(b"y")), (3, "b.MD", bytearray(b"x")), (4, "c.txt", bytearray(b"z")), (5, "d.md", bytearray(b"")), (6, "e.md", bytearray(b"new"))], "seq int, file_name string, content binary")
    assert rows(documents.validate_uploads(f).orderBy("seq"), "reason") == [(None,), ("name exists",), ("content exists",), ("type",), ("empty",), (None,)]
    stored = spark.createDataFrame([("e.md", "?")], "file_name string, file_hash string")
    assert rows(documents.validate_uploads(f, stored).filter("seq = 6"), "reason") == [("name exists",)]


def test_context(spark):
    e = spark.createDataFrame([(0, "A", "t", "d")], "pos int, entity_id string, entity_type string, description string")
    r = spark.createDataFrame([], "pos int, src string, tgt string, keywords string, description string")
    c = spark.createDataFrame([(0, "text", "http://h/a%20b.md"), (1, "more", "")], "pos int, content string, file_path string")
    refs = spark.createDataFrame([("1", "http://h/a%20b.md")], "reference_id string, file_path string")
    said = context.context_string(e, r, c, refs).first()[0]
    assert "A (t): d" in said and "Relationship" not in said and "[a b.md]\ntext\n\n[unknown]\nmore" in said and said.endswith("```\n[a b.md](http://h/a%20b.md)\n```")


def test_events(spark):
    pieces = spark.createDataFrame([(0, "a", None), (1, "", None), (2, "b", None)], "seq int, text string, error string")
    assert rows(context.fold_sse(context.sse_events(pieces)), "answer") == [("ab",)]
    assert context.sse_events(pieces.filter("false")).count() == 1


def test_delete_documents(spark):
    docs = spark.createDataFrame([(1, True), (2, False), (3, False)], "id int, is_in_rag_system boolean")
    left, refused = documents.delete(docs, spark.createDataFrame([(1,), (2,), (9,)], "id int"))
    assert sorted(rows(left, "id")) == [(1,), (3,)] and rows(refused, "id") == [(1,)]


SMALL = "/root/testdata/sf0.001"


def test_missing_endpoints_of_the_whole_graph(spark):
    edges = plans.views.Data(spark, SMALL).kg_edges.collect()
    want = {}
    for e in sorted(edges, key=lambda e: (e["src"], e["tgt"])):
        for end in (e["src"], e["tgt"]):
            if not end.startswith("customer:"):
                want.setdefault(end, ([], []))
                for have, new in zip(want[end], (e["description"], e["source_id"]), strict=True):
                    if new not in have:
                        have.append(new)
    got = rows(plans.QUERIES["merge_missing_endpoints_all"](spark, SMALL), "entity_id", "description", "source_id")
    assert sorted(got) == sorted((k, "<SEP>".join(d), "<SEP>".join(s)) for k, (d, s) in want.items())
    assert {k.split(":")[0] for k, _, _ in got} == {"region", "nation", "supplier", "part"}


def trails(edges, seeds, depth):
    """(start, end) -> fewest edges, over all trails; brute force."""
    found, at = {}, [(s, s, ()) for s in seeds]
    for level in range(1, depth + 1):
        at = [(s, b if a == x else a, (*used, k)) for s, x, used in at for k, (a, b) in enumerate(edges) if x in (a, b) and k not in used]
        for s, x, _ in at:
            found.setdefault((s, x), level)
    return found


def test_subgraph_of_a_graph_with_cycles(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("b", "d"), ("d", "e"), ("e", "f"), ("a", "f"), ("f", "g")]
    nodes = spark.createDataFrame([(x, "t") for x in "abcdefg"], "entity_id string, entity_type string")
    for depth in (1, 2, 3, 4, 5):
        got = graph.subgraph_pairs(nodes, spark.createDataFrame(edges, "src string, tgt string"), "*", depth, 1000)
        assert {(r["start"], r["connected"]): r["depth"] for r in got.collect()} == trails(edges, "abcdefg", depth)


def test_subgraph_of_the_whole_graph(spark):
    got = {(r["start"], r["connected"]): r["depth"] for r in plans.QUERIES["graph_subgraph_all"](spark, SMALL).collect()}
    edges = plans.views.Data(spark, SMALL).kg_edges.collect()
    near = {}
    for e in edges:
        near.setdefault(e["src"], set()).add(e["tgt"])
        near.setdefault(e["tgt"], set()).add(e["src"])
    want = {}
    for start in (x for x in near if x.startswith("region:")):
        seen, front = {start}, {start}
        for level in (1, 2, 3):
            front = {y for x in front for y in near[x]} - seen
            seen |= front
            want |= {(start, y): level for y in front}
    first = sorted((depth, *pair) for pair, depth in want.items())[:1000]
    assert got == {(a, b): depth for depth, a, b in first}
    assert any(b.startswith("part:") for _, b in got)
