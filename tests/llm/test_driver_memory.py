"""What the pipeline's driver is spared: the fit of the language model, and rounds over few links."""

from __future__ import annotations

import os
import random

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import components as C
from weftline.llm import language_id
from weftline.llm.common import Scratch


def test_the_driver_does_not_fit(spark, monkeypatch):
    """It gets the model, and not the sample's features."""
    docs = spark.createDataFrame([(f"the words of {k} are these and those", "en") for k in range(40)] + [(f"die Worte von {k} sind diese und jene", "de") for k in range(40)], "text string, lang string")

    driver, fit = os.getpid(), language_id.fit

    def elsewhere(*given):
        assert os.getpid() != driver, "fitted by the driver"
        return fit(*given)

    monkeypatch.setattr(language_id, "fit", elsewhere)
    model = language_id.learn(docs)
    assert model.labels == ["de", "en"]
    found = language_id.identify(docs, model)
    assert found.filter(F.col("lang") == F.col("lang_pred")).count() == 80


def test_without_labels_there_is_an_empty_model(spark):
    assert language_id.learn(spark.createDataFrame([("text", None)], "text string, lang string")).labels == []


def brute(links):
    root = {n: n for link in links for n in link}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if (root[a], root[b]) != (low, low):
                root[a] = root[b] = low
                changed = True
    return root


def graph():
    r = random.Random(4)
    path = [(k, k + 1) for k in range(0, 60)]
    star = [(1000, k) for k in range(700, 760)]
    chance = [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(150)]
    return [x for x in path + star + chance + [(-5, 9000), (9000, -7), (-(1 << 62), 1 << 62)] if x[0] != x[1]]


def test_roots_are_those_of_brute_force():
    links = graph()
    for seed in range(5):
        random.Random(seed).shuffle(links)
        a, b = (np.array(c, np.int64) for c in zip(*links, strict=True))
        assert dict(zip(*(x.tolist() for x in C.roots(a, b)), strict=True)) == brute(links)


def test_few_links_and_rounds_give_the_same_components(spark):
    links = graph()
    rows = spark.createDataFrame(links + links[:20] + [(b, a) for a, b in links[:20]] + [(5, 5)], "a bigint, b bigint")
    for i, last in enumerate((C.LAST, len(links) // 2, 0)):
        found = C.components(rows, Scratch(spark, f"few-{i}"), "t", last=last).collect()
        assert len(found) == len(brute(links)) and {tuple(r) for r in found} == set(brute(links).items())
    assert not C.components(rows.filter("false"), Scratch(spark, "none"), "t").collect()


def test_few_links_take_few_jobs(spark):
    rows = spark.createDataFrame(graph(), "a bigint, b bigint")
    spark.sparkContext.setJobGroup("few links", "")
    C.components(rows, Scratch(spark, "jobs"), "t")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links")) <= 8
