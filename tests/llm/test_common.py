from __future__ import annotations

import os

from weftline.llm.common import Scratch, remove_scratch, shared_dir, without


def test_scratch(spark, docs):
    scratch = Scratch(spark, "t")
    kept = scratch.keep(docs.select("doc_id"), "a", small=True)
    assert kept.count() == docs.count() and os.path.isdir(scratch.path("a"))
    scratch.drop("a", "never-written")
    assert not os.path.exists(scratch.path("a"))
    scratch.keep(docs.select("doc_id"), "b")
    remove_scratch(spark)
    assert not [f for f in os.listdir(shared_dir(spark)) if f.startswith("weftline-")]


def test_without(docs):
    assert "Score" not in without(docs, "score").columns
