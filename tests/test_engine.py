from __future__ import annotations

from pyspark.sql import functions as F

from weftline.engine import Engine, Options, QueryParam
from weftline.models import Limits
from weftline.operators import taskqueue
from weftline.streaming import progress

#: For tables of a few rows: few files, few tasks, no waiting.
SMALL = {"buckets": 2, "limits": Limits(in_flight=2, attempts=1)}


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "kb"), Options(chunk_tokens=30, chunk_overlap=5, **SMALL))
    docs = spark.createDataFrame([("Alice met Bob in Paris. Bob lives in Paris with Carol. " * 3, "http://x/a%20b.md"), ("Carol works for Acme. Acme is in Berlin.", "notes/c.md"), (" ", "blank.md")], "content string, file_path string")
    assert e.insert_documents(docs) == 2
    nodes = sorted(tuple(r) for r in e.table("nodes").select("entity_id", "description", "source_id").collect())
    assert e.insert_documents(docs) == 0
    assert sorted(tuple(r) for r in e.table("nodes").select("entity_id", "description", "source_id").collect()) == nodes
    found = e.retrieve("Where does Bob live in Paris?")
    assert "Bob -> Paris" in found.context and [r[0] for r in found.references.collect()] == ["1", "2"]
    assert e.retrieve("Bob Paris", QueryParam(mode="local", low_keywords=("Bob",))).relations.count() > 0
    assert e.retrieve("Bob Paris", QueryParam(mode="global", high_keywords=("co-occurrence",))).entities.count() > 0
    assert "".join(e.query("Where does Bob live?")) and "".join(e.query(" ")).startswith("There is nothing")
    _, edges, cut = e.subgraph("Bob", 1)
    assert edges.count() > 0 and not cut
    assert e.document_index().count() == 2 and e.entity_chunks().count() == len(nodes) and e.relation_chunks().count() > 0
    e.clear()
    assert e.table("nodes").count() == 0 and e.retrieve("Bob").context is None


def test_progress_stream(spark, tmp_path):
    schema = progress.EVENTS
    rows = [("a", 1, "chunk", 1, 4), ("b", 2, "chunk", 1, 2), ("a", 3, "merge", 0, 0), ("a", 2, "chunk", 3, 4)]
    events = spark.createDataFrame(rows, schema)
    table, check = str(tmp_path / "table"), str(tmp_path / "check")
    for part in (events.limit(2), events.subtract(events.limit(2))):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        progress.run_to_table(progress.read_events(spark, str(tmp_path / "in")), table, check).awaitTermination()
    got = sorted(tuple(r) for r in progress.read_progress(spark, table).collect())
    assert got == sorted(tuple(r) for r in taskqueue.progress(events).collect()) == [("a", "merge", 75), ("b", "chunk", 50)]
    seen = []
    job = progress.watch(progress.read_events(spark, str(tmp_path / "in")).filter(F.col("total") > 0), lambda df, _: seen.append(df.count()), str(tmp_path / "watch"), "0 seconds")
    job.processAllAvailable()
    job.stop()
    assert sum(seen) == 3


def test_work(spark, tmp_path):
    from weftline import schema

    e, path = Engine(spark, str(tmp_path / "kb"), Options(**SMALL), workspace="w"), str(tmp_path / "tasks")
    row = lambda i, p, text: (i, 1, None, text, f"{i}.md", "Pending", None, 0, None, None, None, None, p, 0, 3)
    spark.createDataFrame([row("a", 1, "Ann met Bea."), row("b", 0, "Cid met Dan.")], schema.TASKS).write.parquet(path)
    assert e.work(path) == 1
    state = lambda: {r["task_id"]: r["status"] for r in spark.read.parquet(path).collect()}
    assert state() == {"a": "Pending", "b": "Completed"} and e.table("full_docs").count() == 1
    e.model = None
    assert e.work(path, 5) == 1
    assert state() == {"a": "Failed", "b": "Completed"}
    assert Engine(spark, str(tmp_path / "kb"), workspace="other").table("nodes").count() == 0


def test_prompts_and_attempts(spark):
    from weftline import models, prompts

    df = spark.createDataFrame([("q", ["a", "b"])], "x string, p array<string>")
    said = df.select(prompts.extraction(F.col("x")), prompts.keywords(F.col("x")), prompts.summary(F.col("x"), F.col("p")), prompts.answer(F.col("x"), F.col("x"), "List")).first()
    assert said[0].endswith("Text:\nq") and said[2].endswith('{"description":"a"}\n{"description":"b"}') and all(said)
    tries = []

    def fails(x):
        tries.append(x)
        if len(tries) < 3:
            raise OSError
        return x

    assert models.with_attempts(fails, 3, 0)(7) == 7 and len(tries) == 3


class Counted:
    """A model and an embedder that leave a line for every call in a file."""

    dimension = 16

    def __init__(self, path):
        self.path = str(path)

    def _note(self, line):
        with open(self.path, "a") as f:
            f.write(line + "\n")

    def embed(self, texts):
        for t in texts:
            self._note("embed " + t.split("\n")[0].split("\t")[0])
        from weftline.models import HashingEmbedder

        return HashingEmbedder(16).embed(texts)

    def extract(self, text):
        from weftline.models import RuleModel

        return RuleModel().extract(text)

    def keywords(self, query):
        return [query], [query]

    def summarize(self, name, parts):
        self._note(f"summarize {name} {len(parts)}")
        return f"{name}: {len(parts)} parts"

    def generate(self, prompt):
        yield prompt


def _graph(e):
    return [sorted(str({k: v for k, v in r.asDict().items() if k != "created_at"}) for r in e.table(t).collect()) for t in ("nodes", "edges", "entity_vectors", "relation_vectors")]


def test_insert_touches_only_new_names(spark, tmp_path):
    log = tmp_path / "log"
    said = Counted(log)
    e = Engine(spark, str(tmp_path / "kb"), Options(chunk_tokens=30, chunk_overlap=5, **SMALL), embedder=said, model=said)
    put = lambda *texts: e.insert_documents(spark.createDataFrame([(t, f"{i}.md") for i, t in enumerate(texts)], "content string, file_path string"))
    assert put("Alice met Bob. Bob met Carol.", "Xena met Yuri.") == 2
    log.write_text("")
    assert put("Alice met Dora.") == 1
    embedded = {x[6:] for x in log.read_text().splitlines() if x.startswith("embed ")}
    assert {"Alice", "Dora"} <= embedded and not embedded & {"Bob", "Carol", "Xena", "Yuri"}
    one = _graph(e)
    assert any("Xena" in x for x in one[0]) and any("Dora" in x for x in one[1])
    e.rebuild_graph()
    assert _graph(e) == one
    assert not list((tmp_path / "kb").glob("*/_runs/*"))


def test_long_descriptions_are_summarised_in_groups(spark, tmp_path):
    log = tmp_path / "log"
    said = Counted(log)
    e = Engine(spark, str(tmp_path / "kb"), Options(chunk_tokens=500, summary_context=12, **SMALL), embedder=said, model=said)
    e.insert_documents(spark.createDataFrame([(f"Alice likes dish number {i} today.", f"{i}.md") for i in range(9)], "content string, file_path string"))
    calls = [x for x in log.read_text().splitlines() if x.startswith("summarize Alice")]
    # Nine parts of six words: four groups of two and one part; their summaries have three words each and make a group of four.
    assert sorted(int(x.split()[-1]) for x in calls) == [2, 2, 2, 2, 4]
    assert [r["description"] for r in e.table("nodes").collect()] == ["Alice: 4 parts<SEP>Alice likes dish number 8 today"]


def test_tokenizer_modes_and_release(spark, tmp_path):
    from weftline import engine as module
    from weftline.functions.tokens import Vocabulary

    letters = Vocabulary(lambda: (lambda t: [ord(c) for c in t], lambda ids: "".join(map(chr, ids))))
    e = Engine(spark, str(tmp_path / "kb"), Options(chunk_tokens=20, chunk_overlap=4, **SMALL), tokenizer=letters)
    assert e.insert_documents(spark.createDataFrame([("Alice met Bob in Paris, said Carol.", "a.md")], "content string, file_path string")) == 1
    # The last two tokens are a remainder within the overlap: the chunk before gets them once more.
    assert [r["content"] for r in e.table("text_chunks").orderBy("chunk_order_index").collect()] == ["Alice met Bob in Par", "Paris, said Carol.ol."]
    module.STRATEGIES["chunks only"] = module.Strategy(False, True, True)
    try:
        found = e.retrieve("Alice met Bob", QueryParam(mode="chunks only"))
        assert found.chunks.count() and list((tmp_path / "kb").glob("*/_runs/*"))
        found.release()
        assert not list((tmp_path / "kb").glob("*/_runs/*"))
    finally:
        del module.STRATEGIES["chunks only"]


def test_broken_swap_is_never_an_empty_table(spark, tmp_path):
    from weftline.operators import kv

    path = str(tmp_path / "t")
    kv.replace_table(spark.range(3), path)
    (tmp_path / "t").rename(tmp_path / "t.old")
    assert kv.current_path(spark, path).endswith("t.old")
    spark.range(5).write.parquet(f"{path}.new")
    assert spark.read.parquet(kv.current_path(spark, path)).count() == 5
    kv.replace_table(spark.range(7), path)
    assert spark.read.parquet(path).count() == 7 and kv.current_path(spark, path) == path


def test_folder_with_a_bad_document(spark, tmp_path):
    class Picky(Counted):
        def extract(self, text):
            if "poison" in text:
                raise ValueError("cannot read this")
            return super().extract(text)

    for name, text in (("a", "Alice met Bob."), ("b", "a poison text"), ("c", "Carol met Dan."), ("d", "Alice met Bob.")):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "SKILL.md").write_text(text)
    picky = Picky(tmp_path / "log")
    e = Engine(spark, str(tmp_path / "kb"), Options(**SMALL), embedder=picky, model=picky)
    assert e.insert_folder(str(tmp_path / "in")) == {"inserted": 2, "skipped": 1, "failed": 1}
    assert {"Alice", "Dan"} <= {r["entity_id"] for r in e.table("nodes").collect()}


def _recounted(e):
    from weftline.operators import graph

    return sorted(tuple(r) for r in graph.degrees(e.table("edges")).collect())


def test_shared_chunks_have_one_vector_and_degrees_are_kept(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "kb"), Options(chunk_tokens=11, chunk_overlap=0, **SMALL))
    shared = "Alice met Bob in Paris and then Carol met Dan too."
    put = lambda text, name: e.insert_documents(spark.createDataFrame([(text, name)], "content string, file_path string"))
    put(shared + " Eve met Frank there.", "a.md")
    put(shared + " Gina met Hans here.", "b.md")
    vectors, texts = e.table("chunk_vectors"), e.table("text_chunks")
    assert vectors.count() == vectors.select("id").distinct().count() == texts.select("chunk_id").distinct().count() < texts.count()
    found = e.retrieve("Alice met Bob", QueryParam(mode="mix", chunk_top_k=3, rerank=False))
    ids = [r["chunk_id"] for r in found.chunks.collect()]
    assert len(ids) == len(set(ids))
    kept = lambda: sorted(tuple(r) for r in e.table("degrees").collect())
    assert kept() == _recounted(e)
    # A run that was lost after its facts is done again: nothing is there twice.
    e.store("full_docs").overwrite(e.table("full_docs").filter("file_path = 'a.md'"))
    before = _graph(e)
    put(shared + " Gina met Hans here.", "b.md")
    assert _graph(e) == before and e.table("chunk_vectors").count() == vectors.count() and e.table("text_chunks").count() == texts.count()
    e.delete_nodes(spark.createDataFrame([("Bob",), ("nobody",)], "entity_id string"))
    assert kept() == _recounted(e) and "Bob" not in {r["entity_id"] for r in e.table("nodes").collect()} | {x for r in e.table("edges").collect() for x in (r["src"], r["tgt"])}
    pair = e.table("edges").first()
    e.remove_edges(spark.createDataFrame([(pair["tgt"], pair["src"])], "src string, tgt string"))
    assert kept() == _recounted(e) and not e.near("edges", spark.createDataFrame([(pair["src"],)], "entity_id string")).filter(F.col("tgt") == pair["tgt"]).count()


def test_lookups_open_few_files(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "kb"), Options(buckets=16))
    rows = spark.range(400).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.lit("text").alias("content"), F.lit(1).alias("tokens"), F.lit(0).alias("chunk_order_index"), F.lit("d").alias("full_doc_id"), F.lit("f.md").alias("file_path"))
    e.store("text_chunks").append(rows)
    chosen = spark.createDataFrame([("c3",), ("c17",)], "chunk_id string")
    found = e._texts(chosen)
    assert found.count() == 2 and len(found.inputFiles()) <= 2 < len(e.table("text_chunks").inputFiles())
    # What is shuffled is the rows that were found: the scan goes straight into a broadcast join.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "In(chunk_id" in plan or "chunk_id#" in plan


def test_many_questions_are_as_single_ones(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "kb"), Options(chunk_tokens=30, chunk_overlap=5, **SMALL))
    docs = [("Alice met Bob in Paris. Bob lives in Paris with Carol. " * 3, "a.md"), ("Carol works for Acme. Acme is in Berlin.", "c.md"), ("Dan likes Eve. Eve lives in Rome near Acme.", "d.md")]
    e.insert_documents(spark.createDataFrame(docs, "content string, file_path string"))
    asked = [(1, "Where does Bob live in Paris?"), (2, "Carol and Acme in Berlin"), (3, "zzzz")]
    p = QueryParam(rerank=False, top_k=6, max_entity_tokens=40, max_relation_tokens=60, max_total_tokens=200)
    got = {r["question_id"]: r["context"] for r in e.retrieve_many(spark.createDataFrame(asked, "question_id int, question string"), p).collect()}
    assert got == {i: e.retrieve(q, p).context for i, q in asked} and any(got.values())
    # With an index the same rows are found: it probes all lists of a store this small.
    for name in ("entity_vectors", "chunk_vectors"):
        e.build_index(name, target=1.0)
    e.insert_documents(spark.createDataFrame([("Bob met Zoe in Paris.", "z.md")], "content string, file_path string"))
    after = e.retrieve(asked[0][1], QueryParam(rerank=False)).context
    assert got[1] != after and "Zoe" in after
