"""The engine: a knowledge base in a folder of Parquet tables, documents in, context out."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import models, schema
from .functions.ids import canonical, prefixed_md5
from .functions.text import SEP, pack, sanitize_encoding
from .functions.tokens import WORDS, Tokenizer, token_count
from .operators import chunking, context, extract, graph, kv, merge, retrieve, taskqueue, vector
from .operators.buckets import BucketStore
from .operators.vector_index import VectorIndex
from .session import SHORT, numbered, ship_package
from .sources.files import read_folders


@dataclass(frozen=True)
class Strategy:
    """Where a mode looks: entities by low keywords, relations by high keywords, chunks by the question."""

    entities: bool = True
    relations: bool = True
    chunks: bool = False


#: Modes by name; others can be added. Hybrid, naive and bypass search like mix without chunks by vector.
STRATEGIES = {"local": Strategy(relations=False), "global": Strategy(entities=False), "hybrid": Strategy(), "naive": Strategy(), "mix": Strategy(chunks=True), "bypass": Strategy()}
NO_CONTEXT = "There is nothing in the knowledge base that answers this question."


@dataclass(frozen=True)
class Options:
    """How documents are cut and merged."""

    chunk_tokens: int = 1200
    chunk_overlap: int = 100
    max_sources: int = 300
    limit_method: str = merge.FIFO
    max_paths: int = 100
    max_entities: int = 45
    max_relations: int = 60
    related_chunks: int = 5
    summary_context: int = 12_000
    buckets: int = 16
    limits: models.Limits = field(default_factory=models.Limits)

    @classmethod
    def from_dict(cls, values: dict) -> Options:
        known = {k: v for k, v in values.items() if k in cls.__dataclass_fields__}
        return cls(**known)


@dataclass(frozen=True)
class QueryParam:
    mode: str = "mix"
    top_k: int = 40
    chunk_top_k: int = 20
    max_entity_tokens: int = 6000
    max_relation_tokens: int = 8000
    max_total_tokens: int = 30000
    high_keywords: tuple[str, ...] = ()
    low_keywords: tuple[str, ...] = ()
    history: tuple[tuple[str, str], ...] = ()
    rerank: bool = True
    response_type: str = "Multiple Paragraphs"
    threshold: float = vector.THRESHOLD

    def __post_init__(self) -> None:
        if self.mode not in STRATEGIES:
            raise ValueError(f"mode must be one of {tuple(STRATEGIES)}")


@dataclass
class Result:
    """What a question found: ranked lists, references and the text for a prompt (null if nothing was found).

    The lists read tables of this run; ``release`` deletes them when they are no longer needed.
    """

    entities: DataFrame
    relations: DataFrame
    chunks: DataFrame
    references: DataFrame
    context: str | None
    metadata: dict = field(default_factory=dict)
    release: Callable[[], None] = lambda: None


class Engine:
    """Tables under ``path`` in buckets of their keys: an insert rewrites, and a question opens, the buckets of the keys it touches.

    Edges are stored under both of their ends; the degrees of nodes are kept beside them and changed with them.
    """

    PAIR = ("least(source_id, target_id)", "greatest(source_id, target_id)")
    #: Schema, bucket keys, and what a row is known by if that is more.
    TABLES = {
        "full_docs": (schema.FULL_DOCS, ("full_doc_id",)), "text_chunks": (schema.TEXT_CHUNKS, ("chunk_id",), ("chunk_id", "full_doc_id")),
        "entity_facts": (schema.ENTITY_FACTS, ("name",)), "relation_facts": (schema.RELATION_FACTS, PAIR),
        "nodes": (schema.NODES, ("entity_id",)), "edges": (f"{schema.EDGES}, entity_id string", ("entity_id",), ("entity_id", "src", "tgt")), "degrees": ("entity_id string, degree bigint", ("entity_id",)),
        "chunk_vectors": (schema.VECTORS, ("id",)), "entity_vectors": (schema.VECTORS, ("name",)), "relation_vectors": (f"{schema.VECTORS}, src string, tgt string", ("src", "tgt")),
        "llm_cache": ("chunk_id string, response string", ("chunk_id",)),
    }
    #: The vector tables and the key of their rows, by which an index knows them.
    VECTOR_KEYS = {"chunk_vectors": "id", "entity_vectors": "name", "relation_vectors": f"concat(src, '{SEP}', tgt)"}

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None, embedder: models.Embedder | None = None, reranker: models.Reranker | None = None, model: models.LanguageModel | None = None, workspace: str = "_", tokenizer: Tokenizer = WORDS):
        # Every workspace has its own folder: a query never reads another one's files.
        self.spark, self.path, self.options, self.tokenizer = spark, f"{path.rstrip('/')}/workspace={workspace}", options or Options(), tokenizer
        self.embedder, self.reranker, self.model = embedder or models.HashingEmbedder(), reranker or models.OverlapReranker(), model or models.RuleModel()
        ship_package(spark)

    def store(self, name: str) -> BucketStore:
        return BucketStore(self.spark, f"{self.path}/{name}", *self.TABLES[name], buckets=self.options.buckets)

    def table(self, name: str) -> DataFrame:
        """All rows; of edges those under their lower end."""
        rows = self.store(name).read()
        return rows.filter("entity_id = src").drop("entity_id") if name == "edges" else rows

    def near(self, name: str, keys: DataFrame, columns: tuple[str, ...] | None = None, made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Rows by their keys, or what is made of them. Edges by ``entity_id``: all at these ends, under each of them."""
        return self.store(name).near(keys, columns, made)

    def _settle(self, run: str, name: str, rows: DataFrame) -> DataFrame:
        """A short ranked list as a table of its own, so that later steps do not compute it again."""
        rows.write.parquet(f"{self.path}/_runs/{run}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/_runs/{run}/{name}")

    def _release(self, run: str) -> None:
        kv.remove(self.spark, f"{self.path}/_runs/{run}")

    def clear(self, *others: str) -> None:
        """Delete everything that is stored here, and the tables at other paths, such as those of tasks and uploads."""
        for path in [*(f"{self.path}/{name}" for name in self.TABLES), f"{self.path}/_index", f"{self.path}/_runs", *others]:
            kv.remove(self.spark, path)

    def insert_documents(self, docs: DataFrame, now: int = 0) -> int:
        """docs (content, file_path) -> number of new documents. Known texts are skipped; facts only ever grow.

        The names and pairs that the new facts touch are merged anew from all their facts, so that a job that is run again gives the
        same graph; what they do not touch is neither merged, summarised nor embedded again.
        """
        o = self.options
        docs = docs.select(sanitize_encoding(F.col("content")).alias("content"), "file_path").filter("content <> ''").withColumn("full_doc_id", prefixed_md5("doc-", F.col("content")))
        docs = docs.groupBy("full_doc_id").agg(F.min_by("content", "file_path").alias("content"), F.min("file_path").alias("file_path"))
        run = uuid.uuid4().hex
        docs = self._settle(run, "docs", docs)
        new = self._settle(run, "new", docs.join(self.near("full_docs", docs).select("full_doc_id"), "full_doc_id", "left_anti"))
        if new.isEmpty():
            self._release(run)
            return 0
        chunks = chunking.sliding(new, o.chunk_tokens, o.chunk_overlap, tokenizer=self.tokenizer).withColumnRenamed("id", "chunk_id")
        # A text that occurs twice in a document is one chunk, at its first place.
        chunks = self._settle(run, "chunks", chunks.groupBy("full_doc_id", "chunk_id").agg(F.min(F.struct("chunk_order_index", "content", "tokens", "file_path")).alias("c")).select("full_doc_id", "chunk_id", "c.*"))
        failed = models.ask(chunks, "chunk_id", "content", self.model.extract, self.store("llm_cache"), o.limits)
        first = failed.first()
        if first is not None:  # what was answered is stored: the next run asks for the rest only
            raise RuntimeError(f"no response for {failed.count()} chunks; {first['chunk_id']}: {first['error']}")
        said = chunks.join(self.near("llm_cache", chunks).dropDuplicates(["chunk_id"]), "chunk_id")
        keys = ["full_doc_id", "chunk_id", "file_path", "chunk_order_index"]
        stamp = {"timestamp": F.lit(now), "chunk_ord": F.col("chunk_order_index")}
        entities = self._settle(run, "entity_facts", extract.parse_entities(said, keys, o.max_entities).withColumns({**stamp, "source_id": F.col("chunk_id")}))
        relations = self._settle(run, "relation_facts", extract.parse_relations(said, keys, o.max_relations).withColumns({**stamp, "source_chunk_id": F.col("chunk_id")}))
        self.store("entity_facts").append(entities)
        self.store("relation_facts").append(relations)
        # A chunk is stored once for each document, and its vector once: also if other documents, or a lost run of this job, brought it before.
        once = chunks.select(F.col("chunk_id").alias("id"), "content").dropDuplicates(["id"])
        fresh = self._settle(run, "new_chunks", once.join(self.near("chunk_vectors", once).select("id"), "id", "left_anti"))
        embed = models.embed_column(self.embedder)
        vectors = self._settle(run, "chunk_vectors", fresh.select("id", embed(F.col("content")).alias("vector"), F.col("id").alias("name")))
        self.store("chunk_vectors").append(vectors)
        self._index_rows("chunk_vectors", vectors)
        self.store("text_chunks").append(chunks.join(self.near("text_chunks", chunks).select("chunk_id", "full_doc_id"), ["chunk_id", "full_doc_id"], "left_anti"))
        names, pairs = entities.select("name").distinct(), self._links(relations).select("src", "tgt").distinct()
        self._merge(run, self._settle(run, "names", names), self._settle(run, "pairs", pairs), now)
        lists = chunks.groupBy("full_doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_order_index", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunks_list"))
        # Written last: a job that breaks off before is done again.
        self.store("full_docs").append(new.join(lists, "full_doc_id").withColumn("chunks_count", F.size("chunks_list")))
        n = lists.count()
        self._release(run)
        return n

    def insert_folder(self, path: str, now: int = 0) -> dict[str, int]:
        """Insert the documents of a folder's sub-folders -> numbers of inserted, skipped (known) and failed ones.

        They are inserted together. Where that fails, the hash range of their names is halved until a bad document fails alone; the
        number of tries grows with the bad documents, not with the folder.
        """
        docs = read_folders(self.spark, path).withColumn("__h", F.xxhash64("file_path"))
        total, inserted, failed, ranges = docs.count(), 0, 0, [(-(1 << 63), 1 << 63)]
        while ranges:
            low, high = ranges.pop()
            some = docs.filter(F.col("__h").between(low, high - 1))
            try:
                inserted += self.insert_documents(some.drop("__h"), now)
            except Exception:
                names = some.select("__h").distinct().limit(2).count()
                if names > 1:
                    ranges += [((low + high) // 2, high), (low, (low + high) // 2)]
                else:
                    failed += some.count()
        return {"inserted": inserted, "skipped": total - inserted - failed, "failed": failed}

    def _links(self, facts: DataFrame) -> DataFrame:
        """Relation facts with their pair; self-loops and nameless ends fall out."""
        low, high = canonical(F.col("source_id"), F.col("target_id"))
        return facts.filter("source_id <> '' AND target_id <> '' AND source_id <> target_id").withColumns({"src": low, "tgt": high})

    def rebuild_graph(self, now: int = 0) -> None:
        """Nodes, edges and their vectors from all facts."""
        run = uuid.uuid4().hex
        names, pairs = self.table("entity_facts").select("name").distinct(), self._links(self.table("relation_facts")).select("src", "tgt").distinct()
        self._merge(run, self._settle(run, "names", names), self._settle(run, "pairs", pairs), now)
        self._release(run)

    def _merge(self, run: str, names: DataFrame, pairs: DataFrame, now: int) -> None:
        """Merge the facts of names (name) and pairs (src, tgt) into nodes, edges and vectors; all other rows stay as they are.

        The lists are settled: they are small beside the graph after an ordinary insert, all of it after a rebuild.
        """
        o = self.options
        facts = self.near("entity_facts", names).filter("name <> ''").dropDuplicates(["source_id", "full_doc_id", "ord"])
        links = self._links(self.near("relation_facts", pairs, ("src", "tgt"))).dropDuplicates(["source_chunk_id", "full_doc_id", "ord"])
        nodes = self._settle(run, "merged_nodes", merge.merge_entities(facts, None, o.max_sources, o.limit_method, o.max_paths))
        edges = self._settle(run, "merged_edges", merge.merge_relations(links, None, o.max_sources, o.limit_method, o.max_paths))
        nodes = self._summarized(run, "nodes", nodes, F.col("entity_id"))
        edges = self._summarized(run, "edges", edges, F.concat_ws("-", "src", "tgt"))
        self._replace_edges(run, edges.withColumn("created_at", F.lit(now)), pairs)
        embed = models.embed_column(self.embedder)
        # Ends that only relations name have no vector: they are reached through the graph.
        vectors = self._settle(run, "entity_vectors", nodes.select("id", embed(F.concat("entity_id", F.lit("\n"), "description")).alias("vector"), F.col("entity_id").alias("name")))
        self.store("entity_vectors").replace(vectors, names)
        self._index_rows("entity_vectors", vectors, names)
        vectors = self._settle(run, "relation_vectors", edges.select("id", embed(F.concat("keywords", F.lit("\t"), "src", F.lit("\n"), "tgt", F.lit("\n"), "description")).alias("vector"), F.concat_ws("-", "src", "tgt").alias("name"), "src", "tgt"))
        self.store("relation_vectors").replace(vectors, pairs)
        self._index_rows("relation_vectors", vectors, pairs)
        # Touched ends without an entity of their own are described anew by all their edges.
        touched = self._settle(run, "touched", names.select(F.col("name").alias("entity_id")).unionByName(pairs.select(F.explode(F.array("src", "tgt")).alias("entity_id"))).distinct())
        known = self.near("entity_vectors", touched, ("entity_id",)).select(F.col("name").alias("entity_id"))
        bare = self._settle(run, "bare", touched.join(known, "entity_id", "left_anti"))
        at = self.near("edges", bare).select("src", "tgt", "source_id", "description", "file_path").dropDuplicates(["src", "tgt"])
        ends = merge.missing_endpoints(at, known).join(bare, "entity_id", "left_semi")
        common = {"created_at": F.lit(now), "labels": F.array("entity_type")}
        fresh = nodes.withColumns(common).unionByName(ends.withColumns({**common, "truncate": F.lit("")}), allowMissingColumns=True)
        self.store("nodes").replace(self._settle(run, "fresh_nodes", fresh), touched)

    def _replace_edges(self, run: str, edges: DataFrame, pairs: DataFrame | None = None) -> None:
        """Put edges in the place of those of the pairs (src, tgt), or of their own pairs, and count the degrees of their ends in the buckets that this rewrites.

        Counted, not added up: a job that is lost between edges and degrees puts both right when it is run again.
        """
        under = lambda rows: rows.withColumn("entity_id", F.explode(F.array("src", "tgt")))
        self.store("edges").replace(under(edges), None if pairs is None else under(pairs.select("src", "tgt")))
        ends = self._settle(run, "ends", under((edges if pairs is None else pairs).select("src", "tgt")).select("entity_id").distinct())
        count = lambda rows: rows.groupBy("entity_id").agg(F.count("*").alias("degree"))
        self.store("degrees").replace(self.near("edges", ends, made=count), ends)

    def put_edges(self, edges: DataFrame, now: int = 0) -> None:
        """Write edges (src, tgt, description, keywords, weight, source_id, file_path), one for each unordered pair, in the place of those there are."""
        run = uuid.uuid4().hex
        low, high = canonical(F.col("src"), F.col("tgt"))
        edges = edges.withColumns({"src": low, "tgt": high, "created_at": F.lit(now), "truncate": F.lit("")})
        edges = self._settle(run, "edges", edges)
        self._replace_edges(run, edges)
        self._release(run)

    def remove_edges(self, pairs: DataFrame) -> None:
        """Delete the edges of unordered pairs (src, tgt), and their vectors."""
        run = uuid.uuid4().hex
        low, high = canonical(F.col("src"), F.col("tgt"))
        pairs = self._settle(run, "pairs", pairs.select(low.alias("src"), high.alias("tgt")).distinct())
        self._replace_edges(run, self.table("edges").limit(0), pairs)
        self.store("relation_vectors").replace(self.table("relation_vectors").limit(0), pairs)
        self._index_rows("relation_vectors", self.table("relation_vectors").limit(0), pairs)
        self._release(run)

    def delete_nodes(self, ids: DataFrame) -> None:
        """Delete nodes (entity_id), their edges, and the vectors of both."""
        run = uuid.uuid4().hex
        ids = self._settle(run, "ids", ids.select("entity_id").distinct())
        self.remove_edges(self.near("edges", ids).select("src", "tgt").distinct())
        names = ids.select(F.col("entity_id").alias("name"))
        self.store("entity_vectors").replace(self.table("entity_vectors").limit(0), names)
        self._index_rows("entity_vectors", self.table("entity_vectors").limit(0), names)
        self.store("nodes").replace(self.table("nodes").limit(0), ids)
        self._release(run)

    def build_index(self, name: str, **settings) -> VectorIndex:
        """An approximate index over a vector table. Inserts keep it up from then on, and questions use it."""
        rows = self.table(name).select(F.expr(self.VECTOR_KEYS[name]).alias("id"), "vector")
        return VectorIndex.build(rows, f"{self.path}/_index/{name}", **settings)

    def _index(self, name: str) -> VectorIndex | None:
        path = f"{self.path}/_index/{name}"
        return VectorIndex(self.spark, path) if kv.current_path(self.spark, f"{path}/model") else None

    def _index_rows(self, name: str, rows: DataFrame, gone: DataFrame | None = None) -> None:
        index, key = self._index(name), F.expr(self.VECTOR_KEYS[name]).alias("id")
        if index is not None:
            if gone is not None:
                index.delete(gone.select(key))
            index = self._index(name)
            if not rows.isEmpty():
                index.upsert(rows.select(key, "vector"))

    def _summarized(self, run: str, what: str, rows: DataFrame, title: Column) -> DataFrame:
        """rows with a summary as description where one is due.

        Lists of parts that are too long for one call are cut into groups; groups are summarised as rows of their own, in parallel,
        and their summaries take the parts' place until they fit. Every round at least halves the longest list.
        """
        summarize, n = models.summarize_column(self.model, self.options.limits), 0
        due = rows.filter("needs_summary").select("id", title.alias("title"), F.split("description", SEP).alias("parts"))
        size = F.aggregate("parts", F.lit(0), lambda s, x: s + token_count(x))
        fits = (size <= self.options.summary_context) | (F.size("parts") <= 2)
        done = []
        while not due.isEmpty():
            joined, long = merge.join_descriptions(F.col("parts"))
            # The model is called for filtered rows: a call inside a condition would be made for every row.
            ready = due.filter(fits).withColumns({"__joined": joined, "__long": long})
            asked = ready.filter("__long").select("id", summarize(F.col("title"), F.col("parts")).alias("__said"))
            done.append(self._settle(run, f"{what}_said_{n}", asked.unionByName(ready.filter("not __long").select("id", F.col("__joined").alias("__said")))))
            groups = due.filter(~fits).select("id", "title", F.posexplode(merge.description_groups(F.col("parts"), self.options.summary_context)).alias("at", "group"))
            alone = groups.filter(F.size("group") == 1).select("id", "title", "at", F.get("group", F.lit(0)).alias("part"))
            said = groups.filter(F.size("group") > 1).select("id", "title", "at", summarize(F.col("title"), F.col("group")).alias("part")).unionByName(alone)
            regrouped = said.groupBy("id", "title").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]).alias("parts"))
            due, n = self._settle(run, f"{what}_round_{n}", regrouped), n + 1
        for said in done:
            rows = rows.join(said, "id", "left").withColumn("description", F.coalesce("__said", "description")).drop("__said")
        return self._settle(run, f"{what}_summarized", rows) if done else rows

    def _hits(self, name: str, wanted: list[float], p: QueryParam, k: int) -> DataFrame:
        """The k nearest rows of a vector table, by its index if there is one."""
        index = self._index(name)
        if index is None:
            return vector.top_k(self.table(name), wanted, k, p.threshold)
        found = index.search(self.spark.createDataFrame([(0, [float(x) for x in wanted])], "query_id int, vector array<float>"), k, p.threshold).select(F.col("id").alias("__key"), "score", "pos")
        return self.near(name, self._keys_of(name, found)).withColumn("__key", F.expr(self.VECTOR_KEYS[name])).join(F.broadcast(found), "__key").drop("__key")  # k rows

    def _vectors(self, question: str, high: list[str], low: list[str], way: Strategy) -> dict[str, list[float]]:
        """The vectors that a search needs, in one call. Without that of the question it goes on, without chunks by vector."""
        texts = {"low": ", ".join(low)} if way.entities else {}
        texts |= {"high": ", ".join(high)} if way.relations else {}
        every = texts | ({"question": question} if way.chunks else {})
        try:
            return dict(zip(every, self.embedder.embed(list(every.values())), strict=True))
        except Exception:
            if not way.chunks:
                raise
            return dict(zip(texts, self.embedder.embed(list(texts.values())), strict=True))

    def retrieve(self, question: str, p: QueryParam | None = None) -> Result:
        """Search by the mode's strategy."""
        p = p or QueryParam()
        way = STRATEGIES[p.mode]
        high, low = (list(p.high_keywords), list(p.low_keywords)) if p.high_keywords or p.low_keywords else self.model.keywords(question)
        wanted = self._vectors(question, high, low, way)
        run = uuid.uuid4().hex
        entities = relations = None
        if way.entities:
            hits = self._settle(run, "local_hits", self._hits("entity_vectors", wanted["low"], p, p.top_k).withColumnRenamed("name", "entity_id").select("pos", "entity_id"))
            entities = self._settle(run, "local_entities", retrieve.local_entities(hits, self.near("nodes", hits), degrees=self.near("degrees", hits)))
            at = self._settle(run, "edges_at", self.near("edges", entities).drop("entity_id").dropDuplicates(["src", "tgt"]))
            ends = at.select(F.explode(F.array("src", "tgt")).alias("entity_id")).distinct()
            found = self._settle(run, "ranked_edges", retrieve.edges_at(entities, at, self.near("degrees", ends)))
            relations = self._settle(run, "local_relations", numbered(found, F.desc("rank"), F.desc("weight"), "src", "tgt", stored=True))
        if way.relations:
            hits = self._settle(run, "global_hits", self._hits("relation_vectors", wanted["high"], p, p.top_k).select("pos", "src", "tgt"))
            low = hits.select(F.least("src", "tgt").alias("entity_id"))
            found = self._settle(run, "global_relations", retrieve.global_relations(hits, self.near("edges", low).filter("entity_id = src").drop("entity_id")))
            ends = self._settle(run, "global_entities", retrieve.global_entities(found, self.near("nodes", found.select(F.explode(F.array("src", "tgt")).alias("entity_id")))))
            entities = ends if entities is None else self._settle(run, "entities", retrieve.merge_entities(entities, ends))
            relations = found if relations is None else self._settle(run, "relations", retrieve.merge_relations(relations, found, long=relations.count() > SHORT))
        near = self.spark.createDataFrame([], "pos int, chunk_id string, content string, file_path string")
        if "question" in wanted:
            near = self._settle(run, "vector_chunks", self._vector_chunks(question, wanted["question"], p))
        # Relations at the entities have no limit: a hub brings all of its edges.
        long = relations.count() > SHORT
        from_entities = self._settle(run, "entity_chunks", retrieve.related_chunks_entities(entities, self._texts, self.options.related_chunks))
        from_relations = self._settle(run, "relation_chunks", retrieve.related_chunks_relations(relations, self._texts, from_entities, self.options.related_chunks, long=long))
        chunks = retrieve.merge_chunks(near, from_entities, from_relations, long=long)
        chunks = self._settle(run, "chunks", retrieve.token_budget(chunks, F.col("content"), p.max_total_tokens - p.max_entity_tokens - p.max_relation_tokens, self.tokenizer, long=long))
        refs, chunks = retrieve.references(chunks)
        said = None
        if retrieve.empty_gate(entities, relations, chunks, p.mode):
            budgeted = retrieve.token_budget(entities, context.entity_line(), p.max_entity_tokens, self.tokenizer), retrieve.token_budget(relations, context.relation_line(), p.max_relation_tokens, self.tokenizer, long=long)
            said = context.context_string(*budgeted, chunks, refs).first()["context"]
        return Result(entities, relations, chunks, refs, said, {"mode": p.mode, "high_keywords": high, "low_keywords": low}, lambda: self._release(run))

    def retrieve_many(self, questions: DataFrame, p: QueryParam | None = None) -> DataFrame:
        """questions (question_id, question), of any number -> (question_id, context), null where nothing was found.

        One job: every list, quota and budget is kept by question. Questions share the parameters; keywords come from the model, or from
        columns ``high`` and ``low`` (arrays) if there are any. Chunks by vector keep their order: reranking is for single questions.
        """
        p = p or QueryParam()
        way, run, by, o = STRATEGIES[p.mode], uuid.uuid4().hex, ("question_id",), self.options
        keep = lambda name, rows: self._settle(run, name, rows)
        asked = questions.select("question_id", "question", *([] if "low" not in questions.columns else ["high", "low"])).dropDuplicates(["question_id"])
        if "low" not in asked.columns:
            asked = asked.withColumn("k", models.keywords_column(self.model)(F.col("question"))).select("question_id", "question", "k.high", "k.low")
        embed = models.embed_column(self.embedder)
        texts = asked.select("question_id", F.explode(F.create_map(F.lit("low"), F.array_join("low", ", "), F.lit("high"), F.array_join("high", ", "), F.lit("question"), F.col("question"))).alias("kind", "text"))
        wanted = [kind for kind, on in (("low", way.entities), ("high", way.relations), ("question", way.chunks)) if on]
        vectors = keep("vectors", texts.filter(F.col("kind").isin(wanted)).select("question_id", "kind", embed(F.col("text")).alias("vector")))
        of = lambda kind: vectors.filter(F.col("kind") == kind).select("question_id", "vector")
        entities = relations = None
        if way.entities:
            hits = keep("local_hits", self._hits_many("entity_vectors", of("low"), p, p.top_k).withColumnRenamed("name", "entity_id").select("question_id", "pos", "entity_id"))
            entities = keep("local_entities", retrieve.local_entities(hits, self.near("nodes", hits), degrees=self.near("degrees", hits), by=by))
            at = keep("edges_at", self.near("edges", entities).drop("entity_id").dropDuplicates(["src", "tgt"]))
            ends = at.select(F.explode(F.array("src", "tgt")).alias("entity_id")).distinct()
            relations = keep("local_relations", retrieve.local_relations(entities, at, degrees=self.near("degrees", ends), by=by))
        if way.relations:
            hits = keep("global_hits", self._hits_many("relation_vectors", of("high"), p, p.top_k).select("question_id", "pos", "src", "tgt"))
            low = hits.select(F.least("src", "tgt").alias("entity_id"))
            found = keep("global_relations", retrieve.global_relations(hits, self.near("edges", low).filter("entity_id = src").drop("entity_id"), by))
            ends = keep("global_entities", retrieve.global_entities(found, self.near("nodes", found.select(F.explode(F.array("src", "tgt")).alias("entity_id"))), by))
            entities = ends if entities is None else keep("entities", retrieve.merge_entities(entities, ends, by))
            relations = found if relations is None else keep("relations", retrieve.merge_relations(relations, found, by))
        near = asked.limit(0).select("question_id", F.lit(0).alias("pos"), *(F.lit("").alias(c) for c in ("chunk_id", "content", "file_path")))
        if way.chunks:
            hits = self._hits_many("chunk_vectors", of("question"), p, p.chunk_top_k or p.top_k).select("question_id", "pos", F.col("id").alias("chunk_id"))
            near = keep("vector_chunks", retrieve.with_content(keep("chunk_hits", hits), self._texts, by))
        nothing = near.limit(0)
        from_entities = nothing if entities is None else keep("entity_chunks", retrieve.related_chunks_entities(entities, self._texts, o.related_chunks, by))
        from_relations = nothing if relations is None else keep("relation_chunks", retrieve.related_chunks_relations(relations, self._texts, from_entities, o.related_chunks, by))
        chunks = retrieve.merge_chunks(near, from_entities, from_relations, by)
        chunks = keep("chunks", retrieve.token_budget(chunks, F.col("content"), p.max_total_tokens - p.max_entity_tokens - p.max_relation_tokens, self.tokenizer, by))
        refs, chunks = retrieve.references(chunks, by)
        if entities is None:
            entities = asked.limit(0).select("question_id", F.lit(0).alias("pos"), *(F.lit("").alias(c) for c in ("entity_id", "entity_type", "description")))
        if relations is None:
            relations = asked.limit(0).select("question_id", F.lit(0).alias("pos"), *(F.lit("").alias(c) for c in ("src", "tgt", "keywords", "description")))
        budgeted = retrieve.token_budget(entities, context.entity_line(), p.max_entity_tokens, self.tokenizer, by), retrieve.token_budget(relations, context.relation_line(), p.max_relation_tokens, self.tokenizer, by)
        said = context.context_string(*budgeted, chunks, refs, by)
        # Chunks alone are an answer in the mode mix only.
        enough = entities.select("question_id").unionByName(relations.select("question_id"))
        enough = enough.unionByName(chunks.select("question_id")) if p.mode == "mix" else enough
        return asked.select("question_id").join(said.join(enough.distinct(), "question_id", "left_semi"), "question_id", "left")

    def _hits_many(self, name: str, queries: DataFrame, p: QueryParam, k: int) -> DataFrame:
        """The k nearest rows of a vector table for each query (question_id, vector)."""
        index, key = self._index(name), F.expr(self.VECTOR_KEYS[name])
        if index is not None:
            found = index.search(queries, k, p.threshold, query_id="question_id")
        else:
            found = vector.top_k_batch(self.table(name).withColumn("id", key), queries, k, p.threshold, query_id="question_id")
        found = found.withColumnRenamed("id", "__key")
        return self.near(name, self._keys_of(name, found)).withColumn("__key", key).join(found, "__key").drop("__key")

    def _keys_of(self, name: str, found: DataFrame) -> DataFrame:
        parts = F.split("__key", SEP)
        return found.select(F.get(parts, F.lit(0)).alias("src"), F.get(parts, F.lit(1)).alias("tgt")) if name == "relation_vectors" else found.select(F.col("__key").alias(self.VECTOR_KEYS[name]))

    def _texts(self, chosen: DataFrame) -> DataFrame:
        """The chosen chunks (chunk_id) with their texts, each once: that of the first of its documents."""
        return self.near("text_chunks", chosen).groupBy("chunk_id").agg(F.min(F.struct("full_doc_id", "content", "file_path")).alias("c")).select("chunk_id", "c.content", "c.file_path")

    def _vector_chunks(self, question: str, wanted: list[float], p: QueryParam) -> DataFrame:
        hits = self._hits("chunk_vectors", wanted, p, p.chunk_top_k or p.top_k)
        rows = retrieve.with_content(hits.select("pos", F.col("id").alias("chunk_id")), self._texts)
        if p.rerank:
            score = models.rerank_column(self.reranker, question)
            rows = retrieve.ranked(rows.withColumn("score", score(F.col("content"))).drop("pos"), F.desc("score"), "chunk_id").filter(F.col("pos") < (p.chunk_top_k or p.top_k)).drop("score")
        return rows

    def prompt(self, question: str, p: QueryParam, said: str) -> list[tuple[str, str]]:
        """Messages: instructions with the context, the history, the question."""
        system = f"Answer from the context only and cite the files it names. Form of the answer: {p.response_type}.\n\n{said}"
        return [("system", system), *p.history, ("user", question)]

    def query(self, question: str, p: QueryParam | None = None) -> Iterator[str]:
        """The answer in pieces; blank pieces are left out."""
        p = p or QueryParam()
        if not question.strip():
            yield NO_CONTEXT
            return
        found = self.retrieve(question, p)
        said = found.context
        found.release()
        if said is None:
            yield NO_CONTEXT
            return
        yield from (piece for piece in self.model.generate("\n\n".join(text for _, text in self.prompt(question, p, said))) if piece.strip())

    def work(self, tasks_path: str, most: int = 1, now: str = "1970-01-01 00:00:00") -> int:
        """Take up to ``most`` pending tasks, insert their documents together and record how they ended.

        The task table is written twice whatever their number. If the insert fails, they are tried one by one, so that a bad document
        fails alone.
        """
        kv.repair(self.spark, tasks_path)
        tasks = self.spark.read.schema(schema.TASKS).parquet(tasks_path)
        ids = [r["task_id"] for r in taskqueue.next_task(tasks, min(most, kv.MAX_KEYS)).select("task_id").collect()]
        if not ids:
            return 0
        changes = lambda rows: self.spark.createDataFrame(rows, "task_id string, status string, error string")
        kv.replace_table(taskqueue.update(tasks, changes([(i, taskqueue.PROCESSING, None) for i in ids]), now), tasks_path)
        tasks = self.spark.read.schema(schema.TASKS).parquet(tasks_path)
        errors: dict[str, str] = {}
        todo = [ids]
        while todo:
            some = todo.pop()
            try:
                self.insert_documents(tasks.join(changes([(i, None, None) for i in some]).select("task_id"), "task_id", "left_semi").select("content", "file_path"))
            except Exception as e:  # the task carries the error; the queue goes on
                if len(some) == 1:
                    errors[some[0]] = str(e)[:2000]
                else:
                    todo += [[i] for i in reversed(some)]
        kv.replace_table(taskqueue.update(tasks, changes([(i, taskqueue.FAILED if i in errors else taskqueue.COMPLETED, errors.get(i)) for i in ids]), now), tasks_path)
        return len(ids)

    def subgraph(self, label: str = "*", depth: int = 3, max_nodes: int = 1000, mode: str = "reachability") -> tuple[DataFrame, DataFrame, bool]:
        return graph.subgraph(self.table("nodes"), self.table("edges"), label, depth, max_nodes, mode)

    def document_index(self) -> DataFrame:
        return merge.document_index(self.table("entity_facts"), self.table("relation_facts"))

    def entity_chunks(self) -> DataFrame:
        """(entity_id, chunk_ids, count) of all sources, not only those that a node lists."""
        facts = self.table("entity_facts").select(F.col("name").alias("entity_id"), F.col("source_id").alias("c")).distinct()
        return facts.groupBy("entity_id").agg(F.array_sort(F.collect_list("c")).alias("chunk_ids")).withColumn("count", F.size("chunk_ids"))

    def relation_chunks(self) -> DataFrame:
        """(key, chunk_ids, count) with key ``a<SEP>b``."""
        facts = self.table("relation_facts").filter("source_id <> target_id").select(pack(F.array(F.least("source_id", "target_id"), F.greatest("source_id", "target_id"))).alias("key"), F.col("source_chunk_id").alias("c")).distinct()
        return facts.groupBy("key").agg(F.array_sort(F.collect_list("c")).alias("chunk_ids")).withColumn("count", F.size("chunk_ids"))
