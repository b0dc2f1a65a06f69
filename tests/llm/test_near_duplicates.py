from __future__ import annotations

import random

import numpy as np
import pytest

from weftline.llm import components as C
from weftline.llm import jaccard_join as J
from weftline.llm.common import Scratch

from .conftest import LOREM, messy, words

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """Rows (doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        group = [d for k, (d, _) in enumerate(rows) if find(k) == find(i) and d is not None]
        out.append((doc, len(sets[i]), min(group) if group else None))
    return sorted(out, key=str)


def run(spark, rows):
    df = J.jaccard_classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_messy(spark, docs, empty):
    rows = [(r[0], r[1]) for r in messy()]
    assert sorted((tuple(r) for r in J.jaccard_classes(docs).collect()), key=str) == brute(rows)
    assert J.jaccard_classes(empty).count() == 0


def test_random_groups(spark):
    """Chains and clouds of copies with more and more changes, among them pairs at the threshold."""
    rng, rows, k = random.Random(5), [], 0
    for g in range(12):
        base = words(100 + g, rng.choice([5, 6, 9, 20, 80, 200]))
        for _ in range(rng.choice([1, 3, 12])):
            for at in rng.sample(range(len(base)), rng.choice([0, 0, 1, 2])):
                base = [*base[:at], rng.choice(LOREM), *base[at + 1 :]]
            rows.append((k, " ".join(base)))
            k += rng.choice([1, 3])
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize(("tile", "pack"), [(3, 100), (2, 1)])
def test_large_groups_in_tiles(spark, monkeypatch, tile, pack):
    """The way of groups too large for one task gives the same classes."""
    base = words(7, 150)
    rng, rows = random.Random(1), []
    for k in range(40):
        own = list(base)
        for at in rng.sample(range(150), rng.choice([0, 2, 4, 7])):
            own[at] = rng.choice(LOREM)
        rows.append((k, " ".join(own[: rng.choice([150, 140, 120])])))
    whole = J.link_candidates
    monkeypatch.setattr(J, "link_candidates", lambda d, g, s, t: whole(d, g, s, t, tile=tile, pack_words=pack, bloom_bytes=0 if tile == 2 else 1 << 20))
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize(("tile", "pack"), [(1500, 400_000), (3, 100)])
def test_chains_of_chance_shingles_are_split(spark, monkeypatch, tile, pack):
    """Texts that hang together by shared halves are one candidate group; lists of one shingle leave the similar ones together."""
    rows = [(k, " ".join(words(1000 + k, 40) + words(1001 + k, 40))) for k in range(40)]
    rows += [(100 + k, " ".join(words(1000 + k, 40) + ["other"] * (k % 2) + words(1001 + k, 40))) for k in range(0, 40, 5)]
    rows += [(200 + k, " ".join(words(1003, 40) + words(1004, 34) + words(3000 + k, 2))) for k in range(8)]
    whole, sizes = J.split_groups, []

    def split(docs, found, groups, scratch, twice):
        parts = whole(docs, found, groups, scratch, twice, above=5, tile=tile, pack_words=pack)
        sizes.extend(g.count() for g in (groups, parts))
        return parts

    monkeypatch.setattr(J, "split_groups", split)
    assert run(spark, rows) == brute(rows)
    assert sizes[0] == 50 and sizes[1] <= 25  # only classes that have a similar one, or nearly, are left


@pytest.mark.parametrize("n", [1, 4, 40, 700, 9000])
def test_narrow_bound_never_cuts_links(n):
    """16 bits of each shingle link at least what the exact sets link."""
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 62, n).astype(np.uint64)
    sets = [np.unique(base)]
    for k in range(8):
        own = base.copy()
        own[rng.integers(0, n, max(1, n // 8))] = rng.integers(0, 1 << 62, max(1, n // 8)).astype(np.uint64)
        sets.append(np.unique(own[: n - k * n // 40]))

    def groups(links):
        group = list(range(len(sets)))
        for a, b in links:
            group = [group[b] if x == group[a] else x for x in group]
        return group

    exact, loose = groups(J.similar_in(sets)), groups(J.similar_in([s.astype(np.uint16) for s in sets], None, False))
    assert all(loose[i] == loose[j] for i in range(len(sets)) for j in range(i) if exact[i] == exact[j])


def test_common_shingles(spark, monkeypatch):
    """A passage in all documents, counted as common, neither links them nor hides a link."""
    passage = " ".join(words(9, 60))
    rows = [(k, passage + " " + " ".join(words(1000 + k, 30))) for k in range(60)] + [(100 + k, passage + (" x" if k else "")) for k in range(3)]
    monkeypatch.setattr(J, "HEAVY_SHARE", 0.0001)
    assert run(spark, rows) == brute(rows)


def test_bound_never_cuts_links():
    """Bitmap bounds pass every pair that the exact intersection links."""
    rng = np.random.default_rng(3)
    for n in (1, 4, 40, 700):
        base = rng.integers(0, 1 << 62, n).astype(np.uint64)
        sets = [np.unique(base)]
        for _ in range(10):
            own = base.copy()
            own[rng.integers(0, n, max(1, n // 8))] = rng.integers(0, 1 << 62, max(1, n // 8)).astype(np.uint64)
            sets.append(np.unique(own))
        linked = J.similar_in(sets)
        group = list(range(len(sets)))
        for a, b in linked:
            group = [group[b] if x == group[a] else x for x in group]
        for i, a in enumerate(sets):
            for j in range(i):
                same = len(np.intersect1d(a, sets[j]))
                if 4 * same >= 3 * (len(a) + len(sets[j]) - same):
                    assert group[i] == group[j]


def test_halves_that_several_classes_share(spark, monkeypatch):
    """Classes whose ids collide are told apart by the rest of their digest."""
    whole = J.class_key
    monkeypatch.setattr(J, "class_key", lambda s: (whole(s)[0] % 5, whole(s)[1]))
    sets = [np.array(x, np.uint64) for x in ([1, 2], [3], [4, 5, 6])]
    assert len({J.class_id(s, {0, 1, 2, 3, 4}) for s in sets}) == 3 and J.class_id(sets[0], set()) == whole(sets[0])[0] % 5


def test_copies_in_many_blocks(spark):
    """A class that comes from several blocks is counted once."""
    rows = [(k, " ".join(words(40, 400)[: 400 - 3 * k])) for k in range(20)] + [(100 + k, " ".join(words(40, 400)[: 400 - 3 * k])) for k in range(20)]
    assert run(spark, rows) == brute(rows)


def test_hubs(spark, monkeypatch):
    """Centres of many links are broadcast; the components are the same."""
    monkeypatch.setattr(C, "FEW", 5)
    links = [(0, k) for k in range(1, 40)] + [(50, k) for k in range(20, 90)] + [(200 + k, 201 + k) for k in range(9)]
    got = C.components(spark.createDataFrame(links, "a bigint, b bigint"), Scratch(spark, "t"), "t")
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(90)} | {(200 + k, 200) for k in range(10)}


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = C.components(spark.createDataFrame(links, "a bigint, b bigint"), Scratch(spark, "t"), "t")
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100), (103, 100)}
    assert C.components(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark, "t"), "t").count() == 0
