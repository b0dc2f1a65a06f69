from __future__ import annotations

import math
import random

import pytest

from weftline.llm import hard_negatives as H


def brute(rows, k=5, n_positives=5):
    kept = {(i, lab, tuple(math.floor(256 * float(x)) for x in v)) for i, lab, v in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    last = 1 << 70
    out = []
    for a, lab, v in kept:
        if a is None or a % 100:
            continue
        score = lambda w: sum(x * y for x, y in zip(v, w))  # noqa: B023, B905, E731
        order = lambda rs: sorted(rs, key=lambda r: (-r[0], last if r[1] is None else r[1]))
        for s, p in order([(score(w), i) for i, other, w in kept if other == lab and i != a])[:n_positives]:
            fits = order([(score(w), i) for i, other, w in kept if other != lab and 80 * s <= 100 * score(w) <= 100 * s])
            out += [(a, p, r + 1, i, s, t) for r, (t, i) in enumerate(fits[:k])]
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").repartition(3)
    data = H.scaled(df)
    got = H.mine(data, data.filter("vec_id % 100 = 0"), **more)
    return sorted((tuple(r) for r in got.collect()), key=str)


def vectors(n, width, seed, spread=1.0, centres=3):
    r = random.Random(seed)
    middle = [[r.gauss(0, 1) for _ in range(width)] for _ in range(centres)]
    return [(i, r.randrange(3), [0.3 * (c + spread * r.gauss(0, 1)) * (1 + i % 4) for c in middle[i % centres]]) for i in range(n)]


@pytest.mark.parametrize(("width", "spread"), [(4, 1.0), (16, 0.05), (16, 1.0)])
def test_random(spark, width, spread):
    rows = vectors(700, width, width, spread)
    assert run(spark, rows, block_rows=32, pass_anchors=3) == brute(rows)
    assert run(spark, rows) == brute(rows)


def test_slices_leave_rows_out():
    """Close directions: a bucket's slices hold few rows, and none that is needed is lost."""
    import numpy as np

    rng = np.random.default_rng(3)
    hat = rng.normal(size=(500, 6))
    hat /= np.sqrt((hat**2).sum(1))[:, None]
    lists = np.argsort(hat, axis=0).T.astype(np.uint16)
    few = 0
    for q in hat[:100]:
        for bound in (0.5, 0.9, 0.99):
            rows = H._candidates(hat, lists, q, bound)
            if rows is not None:
                few += 1
                assert set(np.flatnonzero(hat @ q >= bound)) <= set(rows) and len(rows) < 400
    assert few > 100


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 1, None), (3, None, [1.0, 0.5]), (4, 1, [nan, 1.0]), (5, 1, [inf, 1.0]), (6, 1, [None, 1.0]), (7, 2, [1.0, 0.5]), (8, 2, [1.0, 0.5]), (8, 2, [1.0, 0.5]),
            (None, 2, [1.0, 0.5]), (None, 1, [1.0, 0.25]), (9, 2, [0.9]), (10, 3, []), (11, 2, [1.0, 0.45, 0.0, 7.0]), (100, 5, [1.0]), (200, 1, [0.0, 0.0]), (-100, 2, [-1.0, -0.5]), (0, 2, [1.0, 0.4])]
    assert run(spark, rows, block_rows=2) == brute(rows)
    assert run(spark, []) == []
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, label int, embedding array<float>, score string")
    assert H.scaled(df).columns == ["vec_id", "label", "v"]


def test_ties_and_copies(spark):
    rows = [(i, i % 2, [0.5, 0.25, -0.125]) for i in range(900)] + [(1000 + i, 2, [0.5, 0.25, i / 256]) for i in range(60)]
    assert run(spark, rows, block_rows=64) == brute(rows)


def test_large_numbers(spark):
    rows = [(i, i % 2, [3e2 * (1 + i % 5), -2e5 * (i % 3), 1e6]) for i in range(150)]
    assert run(spark, rows, block_rows=32) == brute(rows)


def test_scores_beyond_64_bits_are_cut(spark):
    got = run(spark, [(i, i % 2, [1e20, 1e30 * (i % 3)]) for i in range(30)])
    assert got and {r[4] for r in got} == {2**63 - 1} and {r[5] for r in got} == {2**63 - 1}
