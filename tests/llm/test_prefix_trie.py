from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from weftline.llm import prefix_trie as T

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def turn_digest(role, text):
    r = role.encode()
    return hashlib.sha256(str(len(r)).encode() + b":" + r + text.encode()).digest()[:16]


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((-math.inf if turn is None else turn, (role or "").encode(), turn_digest(role or "", text or ""), (role or "", text or "")))
    turns = {c: [t[3] for t in sorted(v)] for c, v in convs.items()}
    new = {}
    for c in turns:
        base, h = c - int(math.fmod(c, 5)), zlib.crc32(str(c).encode()) % 9
        new[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members = {}
    for c, seq in new.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children = {k: [] for k in members}
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = own + sum(saved[x] for x in children[k])
        ends = ",".join(str(c) for c in sorted(members[k]) if new[c] == k)
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = T.build(spark.createDataFrame(rows, SCHEMA).repartition(3), **more)
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def logs(seed, n, longest=12):
    r = random.Random(seed)
    out = []
    for c in range(n):
        r2 = random.Random(r.randrange(6))
        for t in range(r.randrange(1, longest)):
            text = r2.choice(["ja", "né", "", "a longer turn"]) if r.random() < 0.95 else str(r.random())
            out.append((c, t, "user" if t % 2 else "assistant", text))
    return out


def test_shared_beginnings(spark):
    rows = logs(1, 120)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize(("chunk", "per_shard", "piece"), [(3, 20, 16), (1, 7, 64), (4, 10**6, 16)])
def test_long_paths_hot_beginnings_and_ends(spark, chunk, per_shard, piece):
    """Paths over many chunks, shards that share nodes, ends of many conversations in pieces."""
    rows = logs(2, 60) + [(c, t, "user", f"turn {t}") for c in range(200, 240) for t in range(25)] + [(301, t, None, str(t // 60)) for t in range(70)]
    assert run(spark, rows, chunk=chunk, per_shard=per_shard, piece=piece) == brute(rows)


def test_odd_rows(spark):
    rows = [(5, None, "user", "first"), (5, 0, None, None), (5, 0, None, None), (5, 0, "b", "x"), (5, 0, "b", "y"), (-3, 1, "user", "é"), (-5, 1, "user", "é"), (0, 1, "user", "é"), (None, 1, "user", "lost"), (7, 2, "", ""), (8, 1, "", "long " * 30000), (9, 3, "user", "é"), (9, 3, "user", "é")]
    assert run(spark, rows, chunk=2) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(2, 0, "user", "gone")]) == brute([(2, 0, "user", "gone")])
    assert run(spark, [(None, 0, "user", "gone")]) == []
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", depth int, k1 string")
    assert sorted((tuple(r) for r in T.build(df).collect()), key=str) == brute(rows)


def test_slots():
    rng = np.random.default_rng(1)
    k1, k2 = (rng.integers(0, 2**64, 5000, dtype=np.uint64) for _ in range(2))
    k1[:2000] = k1[0]
    table = T.SlotTable(k1, k2)
    assert sorted(table.slots(k1, k2)) == list(range(5000))
    assert (table.slots(k1, k2 + np.uint64(1)) == -1).all()
    assert T.SlotTable(k1[:0], k2[:0]).slots(k1, k2).max() == -1


def test_colliding_digests_are_refused(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, 1, 5, 5, 0, 0, b"a"), (2, 1, 5, 5, 0, 0, b"b")], "c bigint, d bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, t binary")
    rows = rows.withColumns({"shard": F.lit(0), "head": F.lit(False), "more": F.lit(False), "bytes": F.lit(1).cast("bigint"), "chunk": F.lit(0)})
    with pytest.raises(RuntimeError, match="share a digest"):
        T.trie_nodes(rows, T.Scratch(spark, "trie"))
