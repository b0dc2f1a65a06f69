from __future__ import annotations

import random
import re

import numpy as np
import pytest

from weftline.llm import chosen_path as P
from weftline.llm.common import Scratch

from .conftest import LOREM, messy, words

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(zip(w, w[1:])) if len(w) >= 2 else frozenset([tuple(w)] if w else [])  # noqa: B905


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        group = [d for k, (d, _) in enumerate(rows) if find(k) == find(i) and d is not None]
        least = min(group) if group else None
        out.append((doc, len(sets[i]), least, doc == least))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = P.near_classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), **more)
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def changed(base, rng, times):
    base = list(base)
    for at in rng.sample(range(len(base)), times):
        base[at] = rng.choice(LOREM)
    return base


def clouds(seed, n, sizes=(5, 9, 20, 80, 200)):
    """Chains and clouds of copies with more and more changes, among them pairs near the threshold."""
    rng, rows, k = random.Random(seed), [], 0
    for g in range(n):
        base = words(seed * 100 + g, rng.choice(sizes))
        for _ in range(rng.choice([1, 3, 12])):
            base = changed(base, rng, min(len(base), rng.choice([0, 0, 1, 2])))
            rows.append((k, " ".join(base)))
            k += rng.choice([1, 3])
    return rows


def test_messy(spark, docs, empty):
    rows = [(r[0], r[1]) for r in messy()]
    assert sorted((tuple(r) for r in P.near_classes(docs).collect()), key=str) == brute(rows)
    assert P.near_classes(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_clouds(spark, seed):
    rows = clouds(seed, 25)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize(("leaf", "hot"), [(4, 10**6), (4, 12), (30, 1)])
def test_nodes_that_branch(spark, leaf, hot):
    """Many levels, pivots and hot nodes, with a cloud that no branching divides."""
    rng, base = random.Random(9), words(77, 150)
    rows = clouds(3, 20) + [(1000 + k, " ".join(changed(base, rng, rng.choice([0, 1, 2, 5, 8])))) for k in range(60)]
    assert run(spark, rows, leaf=leaf, hot=hot, rounds=8) == brute(rows)


def test_walk_with_small_leaves():
    """A task's walk over rows in batches of any size: every similar pair is linked, through pivots or children, or goes on together."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (3, P.COORDS))
    sig = np.concatenate([base[rng.integers(0, 3, 60)], rng.integers(0, 256, (30, P.COORDS))]).astype(np.uint8)
    noise = rng.random(sig.shape) < 0.08
    sig[noise] = rng.integers(0, 256, noise.sum())
    node = np.sort(rng.integers(1, 6, len(sig))).astype(np.uint64)
    cid = np.arange(len(sig))
    for size in (1, 5, 100):
        import pyarrow as pa

        rows = pa.Table.from_batches([P._members(node, cid, sig)])
        steps = pa.Table.from_batches(list(P._walk(iter(rows.to_batches(max_chunksize=size)), 6)))
        kind, a, b = (steps.column(c).to_numpy() for c in ("kind", "node", "cid"))
        root = {int(c): int(c) for c in cid}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in zip(a[kind == 0], b[kind == 0], strict=True):
            root[find(int(x))] = find(int(y))
        together = {}
        for x, c in zip(a[kind == 1], b[kind == 1], strict=True):
            together.setdefault(int(x), set()).add(int(c))
        agree = P.agreements(sig, sig)
        pairs = [(i, j) for i in cid for j in range(i) if node[i] == node[j] and agree[i, j] >= 52]
        lost = [p for p in pairs if find(p[0]) != find(p[1]) and not any(set(p) <= t for t in together.values())]
        assert len(pairs) > 50 and len(lost) <= 0.1 * len(pairs)


def test_recall_of_candidates(spark):
    """Pairs just above the threshold, among texts that share frequent words: all are candidates."""
    rows, k = [], 0
    for g in range(150):
        base = words(5000 + g, 120)
        rows += [(k, " ".join(base)), (k + 1, " ".join(changed(base, random.Random(g), 6)))]
        k += 2
    scratch = Scratch(spark, "recall")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    classes = scratch.keep(P.classify(docs), "scan").filter("sig is not null")
    links = {(r["a"], r["b"]) for r in P.candidate_links(classes.select("cid", "sig"), scratch).collect()}
    of = {r["doc_id"]: r["cid"] for r in classes.collect()}
    near = [(of[i], of[i + 1]) for i in range(0, k, 2) if 100 * len(shingles(rows[i][1]) & shingles(rows[i + 1][1])) >= 80 * len(shingles(rows[i][1]) | shingles(rows[i + 1][1]))]
    assert len(near) > 100 and all(p in links or p[::-1] in links for p in near)


def test_what_no_round_divides(spark):
    """After the last round all of a node's classes are candidates."""
    rows = clouds(6, 8)
    assert run(spark, rows, rounds=0) == brute(rows)


def test_large_groups_in_tiles(spark):
    base, rng = words(7, 150), random.Random(1)
    rows = [(k, " ".join(changed(base, rng, rng.choice([0, 2, 4, 7]))[: rng.choice([150, 140, 120])])) for k in range(40)]
    assert run(spark, rows, tile=3, pack_words=100) == brute(rows)
