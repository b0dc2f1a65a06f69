from __future__ import annotations

import numpy as np
import pytest

from weftline.operators import vector
from weftline.operators.vector_index import VectorIndex


def clustered(n, width, centres, seed, spread=0.25):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, width))
    return middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, width))


def nearest(v, q, k, threshold=-1.0):
    """(id, score) by a full search in numpy, ties to the smaller id."""
    unit = lambda x: x / np.sqrt((x**2).sum(-1, keepdims=True))
    out = []
    for row in unit(q) @ unit(v).T:
        order = np.lexsort((np.arange(len(row)), -row))[:k]
        out.append([int(i) for i in order if row[i] >= threshold])
    return out


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """100,000 vectors in 300 clusters, and their index."""
    v = clustered(100_000, 16, 300, 1).astype(np.float32)
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = str(tmp_path_factory.mktemp("vectors"))
    pq.write_table(pa.table({"id": np.arange(len(v)), "vector": pa.array(list(v))}), f"{path}/rows.parquet")
    rows = spark.read.parquet(f"{path}/rows.parquet")
    return v, rows, VectorIndex.build(rows, f"{path}/index", lists=200)


def ask(spark, q):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(q)], "query_id int, vector array<float>")


def by_query(found, n):
    out = [[] for _ in range(n)]
    for r in sorted(found.collect(), key=lambda r: r["pos"]):
        out[r["query_id"]].append(r["id"])
    return out


def test_recall_and_files(spark, large):
    v, rows, index = large
    q = clustered(50, 16, 300, 1)[:50]
    got, true = by_query(index.search(ask(spark, q), 10, threshold=-1.0), 50), nearest(v, q, 10)
    assert sum(len(set(a) & set(b)) for a, b in zip(got, true, strict=True)) >= 0.9 * 500
    one = index.lists_for(vector_unit(q[:1]))[0].tolist()
    every = index._read([1]).inputFiles()
    opened = index._read([1], one).inputFiles()
    assert 0 < len(opened) < 0.1 * len(every) and rows.count() == index._read([1]).count()


def vector_unit(q):
    return q / np.sqrt((q**2).sum(1, keepdims=True))


def test_exact_search(spark, large):
    v, _, index = large
    q = np.concatenate([clustered(20, 16, 300, 1), np.random.default_rng(5).normal(size=(5, 16))])
    assert by_query(index.search(ask(spark, q), 7, threshold=0.2, exact=True, probes=1), 25) == nearest(v, np.float32(q).astype(float), 7, 0.2)
    # Blocks of queries give the same as one block.
    assert by_query(index.search(ask(spark, q), 7, threshold=0.2, exact=True, block=4), 25) == nearest(v, np.float32(q).astype(float), 7, 0.2)


def test_changes(spark, tmp_path):
    v = clustered(600, 8, 5, 3).astype(np.float32)
    frame = lambda ids: spark.createDataFrame([(int(i), [float(x) for x in v[i]]) for i in ids], "id bigint, vector array<float>")
    index = VectorIndex.build(frame(range(500)), str(tmp_path / "index"), lists=12)
    q = v[[3, 77, 590]].astype(float)
    search = lambda: by_query(VectorIndex(spark, str(tmp_path / "index")).search(ask(spark, q), 5, threshold=-1.0, exact=True), 3)
    index.upsert(frame(range(500, 600)))
    assert search() == nearest(v, q, 5)
    # A replaced row is found by its new vector only; removed rows are not found.
    moved = v.copy()
    moved[3], moved[10] = v[590] + np.float32(0.01), -v[10]
    index.upsert(spark.createDataFrame([(3, [float(x) for x in moved[3]]), (10, [float(x) for x in moved[10]])], "id bigint, vector array<float>"))
    assert search() == nearest(moved, q, 5)
    index.delete(spark.createDataFrame([(3,), (77,)], "id bigint"))
    far = moved.copy()
    far[[3, 77]] = 0
    with np.errstate(invalid="ignore"):
        want = [[i for i in row if i not in (3, 77)][:5] for row in nearest(moved, q, 7)]
    assert search() == want
    # What a lost writer left behind is not read.
    index._write(frame(range(5)), index.settings.generation + 1, np.ones(index.settings.lists))
    assert search() == want
    index.upsert(frame([77]))
    assert 77 in search()[1]


def test_odd_rows(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [2.0, 0.0]), (6, [1.0]), (7, [0.0, 3.0]), (8, [1.0, 0.0])]
    index = VectorIndex.build(spark.createDataFrame(rows, "id int, vector array<double>"), str(tmp_path / "a"))
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None)], "query_id int, vector array<double>")
    assert by_query(index.search(asked, 2, exact=True), 3) == [[1, 5], [], []] == by_query(index.search(asked, 2), 3)
    assert index.search(asked.filter("false"), 2).count() == 0
    empty = VectorIndex.build(spark.createDataFrame([], "id string, vector array<float>"), str(tmp_path / "b"))
    assert empty.search(asked, 3, exact=True).count() == 0
    with pytest.raises(FileNotFoundError):
        VectorIndex(spark, str(tmp_path / "none"))


def test_batches_of_queries(spark, monkeypatch):
    v = clustered(300, 6, 4, 9)
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id bigint, vector array<double>")
    whole = sorted(vector.top_k_batch(rows, ask(spark, v[:90]), 3).collect())
    monkeypatch.setattr(vector, "MAX_QUERIES", 20)
    assert sorted(vector.top_k_batch(rows, ask(spark, v[:90]), 3).collect()) == whole and len(whole) == 270
