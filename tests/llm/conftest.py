from __future__ import annotations

import random

import pytest

LOREM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, Score string, n_words string, key string, __p string, target string"


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return [r.choice(LOREM) + str(r.randrange(50)) for _ in range(n)]


def messy() -> list[tuple]:
    base = words(1, 120)
    near = [*base[:60], "changed", *base[61:]]
    far = [*base[:60], *words(2, 60)]
    passage = " ".join(words(3, 60))
    texts = [
        (1, " ".join(base), "en", "b"), (2, " ".join(base), "en", "b"), (2, " ".join(base), "en", "b"), (3, " ".join(near).upper(), "en", "a"), (4, " ".join(far), "de", None),
        (5, None, "en", "a"), (6, "", None, "a"), (7, " \n\t ", "fr", "Z"), (8, "one two three", "en", "é"), (9, "ONE two  three", "en", "é"), (10, "<|endoftext|> don't é世界 𝄞 </s>[INST]", "fr", "b"),
        (11, passage + " " + " ".join(words(4, 30)), "en", "b"), (12, " ".join(words(5, 30)) + " " + passage, "en", "b"), (None, passage, "en", "b"), (None, None, None, None),
        (13, "ab" * 400, "en", "b"), (14, "x" + "ab" * 200, "en", "b"), (15, "12 34 !!", "en", "b"), (16, " ".join(words(6, 5000)), "en", "a"), (17, "é" * 130 + "a", "fr", "a"), (18, "é" * 130 + "b", "fr", "a"), (16, "same id, other text " * 12, "en", "a"),
    ]
    return [(i, t, lang, s, len(t or ""), "9", "0.5", "x", "k", "p", "t") for i, t, lang, s in texts]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(messy(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")
