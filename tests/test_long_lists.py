"""Lists without a limit, in blocks, against plain loops and against the way of short lists."""

from __future__ import annotations

import random
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from weftline.operators import retrieve
from weftline.session import running


def polling(items, most, least=1):
    """items: {item: [chunks]} -> the chosen chunks in order."""
    order = sorted(items)
    n = len(order)
    quota = {i: most if n == 1 else int((Decimal(most) - Decimal(k) / Decimal(n - 1) * (most - least)).quantize(Decimal(1), ROUND_HALF_EVEN)) for k, i in enumerate(order)}
    chosen = [c for i in order for c in items[i][: quota[i]]]
    spare = sum(max(0, quota[i] - len(items[i])) for i in order)
    late = [c for i in order for c in items[i][quota[i] :]] if n > 1 else []
    return list(dict.fromkeys(chosen + late[:spare]))


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(retrieve, "BLOCK", 7)


def some_items(seed, n):
    r = random.Random(seed)
    return {i * 3: [f"c{r.randrange(3 * n)}_{k}" for k in range(r.choice([1, 1, 2, 3, 9]))] for i in range(n)}


@pytest.mark.parametrize("n", [1, 2, 5, 101])
def test_polling(spark, n):
    items = some_items(n, n)
    rows = spark.createDataFrame([(i, c, k + 1) for i, cs in items.items() for k, c in enumerate(cs)], "item int, chunk_id string, k int").repartition(3)
    for long in (False, True):
        got = [r["chunk_id"] for r in retrieve.weighted_polling(rows, 5, long=long).orderBy("pos").collect()]
        assert got == polling(items, 5)


def test_polling_of_questions(spark):
    every = {q: some_items(q, q * 4 + 1) for q in range(6)}
    rows = spark.createDataFrame([(q, i, c, k + 1) for q, items in every.items() for i, cs in items.items() for k, c in enumerate(cs)], "q int, item int, chunk_id string, k int")
    for long in (False, True):
        got = retrieve.weighted_polling(rows, 5, by=("q",), long=long).orderBy("q", "pos").collect()
        assert {q: [r["chunk_id"] for r in got if r["q"] == q] for q in every} == {q: polling(items, 5) for q, items in every.items()}


def test_budgets_and_round_robin(spark):
    r = random.Random(3)
    lists = [[(i, f"k{r.randrange(90)}", "w " * r.randrange(6)) for i in range(n)] for n in (120, 33, 0)]
    frames = [spark.createDataFrame(x, "pos int, chunk_id string, content string").repartition(2) for x in lists]
    seen, want = set(), []
    for i in range(120):
        for x in lists:
            if i < len(x) and x[i][1] not in seen:
                seen.add(x[i][1])
                want.append((len(want), x[i][1], x[i][2]))
    merged = retrieve.merge_chunks(*frames, long=True)
    assert sorted(tuple(r) for r in merged.select("pos", "chunk_id", "content").collect()) == want
    total, fits = 0, []
    for row in want:
        total += len(row[2].split())
        if total <= 100:
            fits.append(row)
    for long in (False, True):
        got = retrieve.token_budget(merged, F.col("content"), 100, long=long).select("pos", "chunk_id", "content").collect()
        assert sorted(tuple(r) for r in got) == fits


def test_content_is_joined_last(spark):
    chosen = spark.createDataFrame([(i * 2, f"c{i}") for i in range(60)], "pos int, chunk_id string")
    texts = spark.createDataFrame([(f"c{i}", f"text {i}", "f") for i in range(60) if i % 4], "chunk_id string, content string, file_path string")
    short, long = ([tuple(r) for r in retrieve.with_content(chosen, texts, long=x).select("pos", "chunk_id", "content").orderBy("pos").collect()] for x in (False, True))
    assert short == long and [r[0] for r in long] == list(range(45))


def test_running_sums_of_a_million_rows(spark):
    rows = spark.range(1_000_000).select("id", (F.col("id") * 7919 % 13).alias("v"))
    got = running(rows, F.col("v"), [F.floor(F.col("id") / 4096)], [F.col("id")]).filter("id % 99991 = 0 OR id = 999999").orderBy("id").collect()
    total, want = 0, []
    for i in range(1_000_000):
        total += i * 7919 % 13
        if i % 99991 == 0 or i == 999_999:
            want.append((i, total))
    assert [(r["id"], r["upto"]) for r in got] == want
    plan = running(rows, F.col("v"), [F.floor(F.col("id") / 4096)], [F.col("id")])._jdf.queryExecution().optimizedPlan().toString()
    # The one window without a partition is over sums of blocks.
    assert plan.count("Window") >= 2 and "__of" in plan
