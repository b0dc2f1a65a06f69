"""Every stage of the pipeline against brute force over its own input."""

from __future__ import annotations

import zlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from weftline.llm.queries import byte_bpe

from .conftest import words
from .test_near_duplicates import brute
from .test_text_operators import brute_hits

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, Score string, key string"
GERMAN = "der die das und nicht mit einem auf für sich auch wie durch über schon".split()


def rows():
    base, passage = words(1, 80), words(9, 14)
    texts = [(1, " ".join(base), "en", "a"), (1, " ".join(base), "en", "a"), (2, " ".join([*base[:40], "odd", *base[41:]]), "en", "b"), (3, " ".join(base).upper(), None, None)]
    texts += [(4, " ".join(words(4, 30) + passage + words(5, 20)), "en", "a"), (5, None, "en", "a"), (6, "", None, "b"), (7, "12 34 !!", "en", "b"), (8, "short text", "en", "c"), (9, " ".join(words(6, 3000)), "en", "c")]
    texts += [(100 + i, " ".join(words(50 + i, 20 + i)), "en", "abc"[i % 3] if i % 7 else None) for i in range(30)]
    texts += [(200 + i, " ".join((GERMAN[i % 15 :] + GERMAN) * 2) + f" wort{i} " + " ".join(words(90 + i, 30)).replace("a", "ä"), "de", "a") for i in range(12)]
    return [(i, t, lang, s, len(t or ""), "9", "x", "k") for i, t, lang, s in texts], [(7, " ".join(passage)), (8, None), (9, "")]


def test_stages(spark, tmp_path):
    docs, items = rows()
    sf = str(tmp_path)
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    at, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, at, sf)
        assert name == "token_ids" or made.columns == at.columns
        made.write.parquet(f"{sf}/{name}")
        at = spark.read.parquet(f"{sf}/{name}")
        out[name] = sorted((tuple(r) for r in at.collect()), key=str)

    # Two languages: no score is below 0.4, so only texts without a letter go.
    assert out["language"] == sorted((r for r in docs if r[1] and any(c.isalpha() for c in r[1])), key=str)
    first = {r[:2]: r for r in out["language"]}
    kept = {i for i, _, c in brute(list(first)) if i == c}
    assert out["near_duplicates"] == sorted((r for r in first.values() if r[0] in kept), key=str)
    assert {1, 2, 3} & {r[0] for r in out["near_duplicates"]} == {1}
    hit = {r[0] for r in brute_hits([r[:2] for r in out["near_duplicates"]], items) if r[2]}
    assert 4 in hit and out["decontamination"] == [r for r in out["near_duplicates"] if r[0] not in hit]

    size = {r: len(r[1].split()) for r in out["decontamination"]}
    taken = Counter(out["mixture"])
    assert set(taken) <= set(size) and max(taken.values()) <= 3
    sources = sorted({r[3] for r in size}, key=lambda s: (s is None, s or ""))
    own = {s: sum(n for r, n in size.items() if r[3] == s) for s in sources}
    weight, target, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}, {}, sum(size.values())
    while True:
        open_ = [s for s in sources if s not in target]
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * own[s]]
        if not over:
            break
        target |= {s: 3.0 * own[s] for s in over}
        left -= sum(3 * own[s] for s in over)
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    for s in sources:
        got = sum(size[r] * n for r, n in taken.items() if r[3] == s)
        assert abs(got - target[s]) <= max(n for r, n in size.items() if r[3] == s), s

    encode = Tokenizer.from_file(byte_bpe())
    want = sorted((r[0], len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))) for r in taken.elements() for ids in [[*encode.encode(r[1], add_special_tokens=False).ids, 2]])
    got = spark.read.parquet(f"{sf}/token_ids").select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()
    assert sorted((r[0], r[2], r[3]) for r in got) == want
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:k]) for k in range(len(got))]
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in got)


def test_near_duplicates_of_repeated_and_null_ids(spark):
    """Texts are judged by id and text: of each group one row stays, and different texts of one id do not share a fate."""
    x, y, z = words(21, 60), words(22, 60), words(23, 60)
    near = [*y[:30], "odd", *y[31:]]
    rows = [(3, " ".join(x)), (7, " ".join(x)), (7, " ".join(y)), (None, " ".join(x)), (None, " ".join(near)), (None, " ".join(z)), (7, " ".join(y)), (9, None), (9, ""), (9, None), (None, None), (7, " ".join(z)), (8, " ".join(words(24, 60))), (8, " ".join(words(25, 60)))]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, "s", "group", "k") for i, t in rows], SCHEMA.replace("Score", "group")).repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    want = [(3, " ".join(x)), (7, " ".join(y)), (7, " ".join(z)), (9, None), (9, ""), (None, None), *rows[-2:]]
    assert sorted((tuple(r)[:2] for r in got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("keep", ["nothing", "no text"])
def test_run_on_odd_tables(spark, tmp_path, keep):
    some = [] if keep == "nothing" else [(1, None, None, None, 0, "9", "x", "k"), (None, "", "en", "a", 0, "9", "x", "k")]
    spark.createDataFrame(some, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
