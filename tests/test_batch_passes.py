"""Many questions at once go through the graph twice: for the edges that their hits name, and for the degrees of the ends."""

from __future__ import annotations

import os
import uuid

from weftline.plans import batch
from weftline.plans.views import Data

DATA = "/root/testdata/sf0.001"


def counted(rows, folder):
    """rows through a task that leaves a file each time it runs."""
    os.makedirs(folder)

    def pass_on(batches):
        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        yield from batches

    return rows.coalesce(1).mapInArrow(pass_on, rows.schema)


def test_lists_take_two_passes_over_the_graph(spark, tmp_path):
    plain, d = Data(spark, DATA), Data(spark, DATA)
    assert d.tree_edges.columns and d.rel_vec.columns  # views over the graph as it is
    d._made["kg_edges"] = counted(plain.kg_edges, f"{tmp_path}/runs")
    entities, relations = batch._lists(d)
    assert entities.count() and relations.count()
    assert len(os.listdir(f"{tmp_path}/runs")) == 2


def test_named_edges(spark):
    """At an entity by either end or both, or of a pair in any orientation; each once, others not."""
    edges = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("b", "c", 3), ("c", "d", 4), ("d", "e", 5), ("e", "f", 6)], "src string, tgt string, weight int")
    entities = spark.createDataFrame([(0, "a"), (1, "a"), (0, "b"), (0, None)], "question_id int, entity_id string")
    pairs = spark.createDataFrame([(0, "e", "d"), (1, "d", "e"), (0, "a", "b"), (0, "x", "y"), (0, None, "f")], "question_id int, src string, tgt string")
    found = batch._named(edges, entities, pairs)
    assert found.columns == edges.columns
    assert sorted(r["weight"] for r in found.collect()) == [1, 2, 3, 5]
