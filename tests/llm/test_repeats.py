from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from weftline.llm import bwt_merge as B
from weftline.llm import repeats as R

from .conftest import messy


def brute(rows, order=None):
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256); rows come in their order."""
    seen, out = set(), []
    for doc, text in rows:
        raw = (text or "").encode()
        cover = bytearray(len(raw))
        own = []
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen:
                cover[k : k + 100] = b"\1" * 100
            seen.add(w)
            own.append(w)
        spans = sum(1 for k, c in enumerate(cover) if c and not (k and cover[k - 1]))
        out.append((doc, len(raw), sum(cover), spans, hashlib.sha256(bytes(b for b, c in zip(raw, cover, strict=True) if not c)).hexdigest()))
    return sorted(out, key=str)


def run(df):
    got = R.remove_repeats(df)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_messy(docs, empty):
    rows = [(r[0], r[1]) for r in messy()]
    # Null ids come first; the two texts under id 16 have nothing in common but are each in its place.
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    assert run(docs) == brute(rows)
    assert run(empty) == []


def corpus(seed):
    rng, rows = random.Random(seed), []
    make = lambda n: "".join(rng.choice("abcdefgh é ") for _ in range(n))
    passages = [make(rng.choice([60, 98, 99, 100, 101, 130, 400])) for _ in range(8)]
    for k in range(60):
        text = make(rng.choice([0, 5, 50, 300]))
        for _ in range(rng.choice([0, 1, 2, 4])):
            p = rng.choice(passages)
            a = rng.randrange(0, max(1, len(p) - 90))
            text += p[a:] + make(rng.choice([0, 1, 17, 80]))
        rows.append((k, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_passages(spark, seed):
    rows = corpus(seed)
    assert run(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)) == brute(rows)


def test_small_pieces(spark, monkeypatch):
    """Slices of a few bytes, and cores that are worked off in pieces: nothing changes."""
    rng = random.Random(8)
    line = "".join(rng.choice("abcdefghij") for _ in range(99))
    rows = [(k, rng.choice("xyz") + line + rng.choice("xyz") + "".join(rng.choice("klmnop") for _ in range(60))) for k in range(80)] + corpus(4)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    segments, merge = R._segments, R._merge

    def small_segments(batches):
        R.SLICE = 500
        return segments(batches)

    def small_merge(batches):
        R.CHUNK = 20

        def thin():
            for b in batches:
                for i in range(0, b.num_rows, 7):
                    yield b.slice(i, 7)

        return merge(thin())

    monkeypatch.setattr(R, "_segments", small_segments)
    monkeypatch.setattr(R, "_merge", small_merge)
    assert run(df) == brute(rows)


def test_long_text_and_runs(spark):
    """A text of several MB, runs of one byte, and a text that repeats itself."""
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(4_300_000))
    rows = [(1, long), (2, long[4_000_000:4_000_150]), (3, "z" * 1000), (4, "z" * 99), (5, long[:200] + long[:200])]
    got = {r[0]: r for r in run(spark.createDataFrame(rows, "doc_id bigint, text string"))}
    assert got[1][2] == 0 and got[2][2:4] == (150, 1) and got[4][2] == 0 and got[5][2] == 400
    # z * 1000: every window but the first repeats it, so all but its first byte is covered.
    assert got[3][2] == 999


def test_blocks_are_equal_substrings():
    rng = np.random.default_rng(1)
    for depth in (1, 3, 6):
        shards, texts, base = [], [], 0
        for _ in range(3):
            rows = [rng.integers(1, 4, rng.integers(1, 12)) for _ in range(5)]
            symbols = np.concatenate([np.append(r, 0) for r in rows])
            ends = np.cumsum([len(r) + 1 for r in rows]) - 1
            shards.append((symbols, ends))
            start = 0
            for r in rows:
                texts += [(base + start + i, tuple(r[i : i + depth])) for i in range(len(r)) if i + depth <= len(r)]
                start += len(r) + 1
            base += len(symbols)
        place, block = B.repeated(shards, depth)
        of = dict(zip(place.tolist(), block.tolist(), strict=True))
        assert sorted(place.tolist()) == list(range(base))
        for p, s in texts:
            for q, t in texts:
                assert (of[p] == of[q]) == (s == t)
