"""Work that has to stay in as many tasks as its input has, whatever the size of what comes out."""

from __future__ import annotations

import os

from pyspark import TaskContext
from pyspark.sql import functions as F

from weftline import plans
from weftline.functions.ids import relation_id
from weftline.operators import merge, vector
from weftline.operators.buckets import BucketStore
from weftline.session import settle

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_short_lists_are_computed_in_many_tasks(spark):
    """One task writes a short list; the rows that it is picked from do not all go through that task."""

    def pick(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            own = b.filter(pc.equal(pc.bit_wise_and(b.column(0), 511), 7))
            yield pa.record_batch([own.column(0), pa.array([TaskContext.get().partitionId()] * own.num_rows, pa.int64())], ["id", "task"])

    kept = settle(spark.range(0, 8000, 1, 8).mapInArrow(pick, "id bigint, task bigint"), "test")
    assert {r["task"] for r in kept.collect()} == set(range(8))
    assert len(kept.inputFiles()) == 1


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_missing_endpoints_gather_each_edge_once(spark):
    """One list for each end, instead of one for each column with the pair in each of them."""
    edges = spark.createDataFrame([("a", "b", "s1", "d1", "f1"), ("a", "c", "s1", "d2", ""), ("b", "c", "", "d1", None)], "src string, tgt string, source_id string, description string, file_path string")
    found = merge.missing_endpoints(edges, spark.createDataFrame([("a",)], "entity_id string"))
    assert _plan(found).count("collect_list(") == 1
    got = {r["entity_id"]: (r["description"], r["source_id"], r["file_path"]) for r in found.collect()}
    assert got == {"b": ("d1", "s1", "f1"), "c": ("d2<SEP>d1", "s1", "")}


def test_replaced_vectors_are_found_in_one_pass(spark):
    """The store and the relations are each computed once: the graph's edges come from lineitem twice, not three times or more."""
    got = plans.QUERIES["merge_relation_vector_replace_all"](spark, SMALL)
    assert _plan(got).count("Aggregate [l_suppkey") == 2


def test_replaced_vectors_with_repeated_and_null_ids(spark):
    gone = spark.createDataFrame([("a", "b")], "src string, tgt string")
    ids = [r[0] for r in gone.select(relation_id(F.col("tgt"), F.col("src"))).collect()] * 2 + ["other", None]
    left, stale = merge.replace_relation_vectors(spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id string, n int"), gone)
    assert left.columns == ["id", "n"] and sorted(r["n"] for r in left.collect()) == [2, 3]
    assert [r["id"] for r in stale.collect()] == ids[:1]


def test_counts_of_many_keys_are_made_before_they_are_picked(spark, tmp_path):
    """A store's rows are counted where they lie; what is joined with the keys is one row for each key."""
    store = BucketStore(spark, f"{tmp_path}/t", "k string, v bigint", ("k",), ("k", "v"), buckets=4)
    row = spark.range(3000).select(F.concat(F.lit("k"), F.col("id") % 1000).alias("k"), F.col("id").alias("v"))
    store.replace(row)
    store.replace(row.filter("v < 10"))
    count = lambda rows: rows.groupBy("k").agg(F.count("*").alias("n"))
    many = spark.range(500, 1500).select(F.concat(F.lit("k"), "id").alias("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for many keys
    try:
        found = store.near(many, made=count)
        assert "Join LeftSemi" in _plan(found).split("Aggregate [k")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r["k"], r["n"]) for r in found.collect()) == sorted((f"k{i}", 3) for i in range(500, 1000))
    few = spark.createDataFrame([("k5",), ("none",)], "k string")
    assert [tuple(r) for r in store.near(few, made=count).collect()] == [("k5", 3)]
    assert store.near(few.filter("false"), made=count).columns == ["k", "n"]
    assert store.read().count() == 3000


def test_scores_of_a_few_rows_at_once(spark, monkeypatch):
    """However few rows a task scores at once, each query has the same nearest rows, ties included."""
    rows = spark.range(0, 300, 1, 2).select("id", F.array(*(F.hash("id", F.lit(i)).cast("double") % 3 for i in range(4))).alias("vector"))
    asked = rows.filter("id % 30 = 0").select(F.col("id").alias("query_id"), "vector")
    found = lambda: sorted((r["query_id"], r["pos"], r["id"], round(r["score"], 9)) for r in vector.top_k_batch(rows, asked, 7).collect())
    whole = found()
    monkeypatch.setattr(vector, "SCORES", 50)
    assert found() == whole
