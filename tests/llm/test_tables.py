from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from weftline.llm import chat_format as C
from weftline.llm import mixing as M
from weftline.llm import url_filter as U
from weftline.llm import warc_archive as W
from weftline.llm.common import Scratch

from .conftest import messy

RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "block"), ("example.net/de/8", "block"), ("org/es/", "block")]
URLS = [
    None, "", "example.com/en/7", "http://a.EXAMPLE.com/en/71", "https://com/en/", "http://xcom/en/", "http://a.example.net/de/81?x#y", "http://b.net/de/", "http://b.org/ES/x", "http://b.org/es/x", "ftp://é.com/en/é", "http://b.org?/es/", "http://b.org#/es/",
    "x://y.com/en/://z", "http:///en/", "http://a..com/en/", "http://com:80/en/", "http://b.org/es/x", "http://example.com/en/6", "http://b.com/en" + "/" * 3000,
]


def judge(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
    best = None
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, *(best or (None, "allow"))


@pytest.mark.parametrize("options", [{}, {"bits_per_key": 1, "n_hashes": 1}, {"max_filter_bytes": 4, "resident_bytes": 8}])
def test_urls(spark, options):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id int, url string, host string, __keys string").repartition(3)
    got = U.judge(pages, spark.createDataFrame(RULES, "rule string, verdict string"), **options)
    assert got.columns[:2] == ["page_id", "url"] and "__keys" in got.columns
    assert [tuple(r) for r in got.orderBy("page_id").select("host", "path", "rule", "verdict").collect()] == [judge(u, RULES) for u in URLS]
    assert U.judge(pages.filter("false"), spark.createDataFrame(RULES, "rule string, verdict string"), **options).count() == 0
    none = U.judge(pages, spark.createDataFrame([], "rule string, verdict string"), **options)
    assert none.filter("verdict = 'block' OR rule IS NOT NULL").count() == 0


def test_cascade_is_exact(spark):
    """Thousands of keys and filters so small that many levels are needed."""
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    (cascade,) = U.build_cascades(keys, Scratch(spark, "t"), "t", bits_per_key=3, n_hashes=2, max_filter_bytes=1 << 20, max_levels=60)
    assert len(cascade.levels) > 3
    probed = cascade.with_filters(keys, "c").withColumn("found", cascade.listed(F.col("key"), "c"))
    assert probed.filter("found <> listed").count() == 0


def test_lists_beyond_one_filter(spark):
    """Shards with a cascade each, and urls judged in several passes, give what one filter gives."""
    rules = [(f"h{k}.com/{'p' * (k % 5)}", "block" if k % 3 else "allow") for k in range(30)]
    urls = [f"http://{'a.' * (k % 2)}h{k % 45}.com/{'p' * (k % 7)}" for k in range(90)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string").repartition(3)
    got = U.judge(pages, spark.createDataFrame(rules, "rule string, verdict string"), max_filter_bytes=24, resident_bytes=50)
    assert [tuple(r) for r in got.orderBy("page_id").select("host", "path", "rule", "verdict").collect()] == [judge(u, rules) for u in urls]


def test_many_path_lengths(spark):
    """Rules of more than 4096 different path lengths all match."""
    rules = [("x.com/" + "p" * n, "block" if n % 2 else "allow") for n in range(0, 4300)]
    urls = ["http://x.com/" + "p" * n + t for n, t in ((0, ""), (1, "q"), (4095, ""), (4097, "q"), (4299, ""), (4299, "pp"))]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")
    got = U.judge(pages, spark.createDataFrame(rules, "rule string, verdict string"))
    assert [tuple(r) for r in got.orderBy("page_id").select("host", "path", "rule", "verdict").collect()] == [judge(u, rules) for u in urls]


def lineage(df):
    return df._jdf.queryExecution().toRdd().toDebugString()


def test_no_python_on_native_paths(spark, tmp_path, monkeypatch):
    """Neither the plans nor what is executed for the two native queries holds a Python worker, a join without keys or an RDD of rows."""
    from weftline.llm import common, queries

    base = spark.range(20).select(F.col("id").alias("page_id"), F.concat(F.lit("http://b.com/en/"), "id").alias("url"))
    base.write.parquet(str(tmp_path / "pages.parquet"))
    base.select(F.col("page_id").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), F.lit("user").alias("role"), F.col("url").alias("text")).write.parquet(str(tmp_path / "conversations.parquet"))
    kept = []
    whole = common.Scratch.keep
    monkeypatch.setattr(common.Scratch, "keep", lambda self, df, *a, **k: kept.append(df) or whole(self, df, *a, **k))
    made = [queries.op1_url_filter(spark, str(tmp_path)), queries.op9_chat_format(spark, str(tmp_path))]
    assert len(kept) > 3
    for df in kept + made:
        plan = df._jdf.queryExecution().executedPlan().toString() + lineage(df)
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


# WARC


def test_warc(spark, tmp_path):
    big, other = "é" * 600, "b" * 1000
    rows = [(1, "http://a", big, "z"), (2, "http://b\r\nX: y", big, "z"), (3, None, big, "z"), (4, "u", "small", "z"), (5, "u", "small", "z"), (6, "u", None, "z"), (7, "u", "", "z"), (8, "u", other, "z"), (9, "u", "b" * 999, "z"), (10, "u", "b" * 999, "z"), (3, "again", big, "z"), (None, "u", big, "z"), (-5, "u", other, "z")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, address string").repartition(3)
    W.write_archive(pages, str(tmp_path / "a"))
    got = W.read_archive(spark, str(tmp_path / "a")).collect()
    want = []
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        owner = max((j for j, _, h, _ in rows if (h or "").encode() == raw and j is not None), default=None)
        revisit = len(raw) >= 1000 and i != owner
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", owner if revisit else None))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted(want, key=str)
    assert spark.read.parquet(str(tmp_path / "a" / "payloads")).count() == len({h or "" for _, _, h, _ in rows})
    for r in got:
        body = b"" if r["record_type"] == "revisit" else bytes(r["payload"])
        record = bytes(r["record"])
        assert record == r["header"].encode() + body + b"\r\n\r\n" and f"Content-Length: {len(body)}\r\n".encode() in record
        assert record.startswith(b"WARC/1.1\r\n") and record.count(b"WARC-Target-URI") == 1 and record.count(b"WARC-Date: 1970-01-01T00:00:00Z\r\n") == 1
        assert (b"\r\nWARC-Profile: http://netpreserve.org/" in record) == (r["record_type"] == "revisit")
    W.write_archive(pages.filter("false"), str(tmp_path / "none"))
    assert W.read_archive(spark, str(tmp_path / "none")).count() == 0


def test_warc_damage(spark, tmp_path):
    """A payload that is not the one of its address stops the read."""
    import shutil

    W.write_archive(spark.createDataFrame([(1, "u", "text")], "page_id bigint, url string, html string"), str(tmp_path / "a"))
    address = spark.read.parquet(str(tmp_path / "a" / "payloads")).first()["address"]
    shutil.rmtree(tmp_path / "a" / "payloads")
    spark.createDataFrame([(address, bytearray(b"x"))], "address string, payload binary").write.parquet(str(tmp_path / "a" / "payloads"))
    with pytest.raises(Exception, match="damaged payload"):
        W.read_archive(spark, str(tmp_path / "a")).collect()


# Mixing


def by_hand(sizes):
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        shares = sum(weight[s] for s in order if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / shares for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 1, "b": 1000, None: 5}, {"b": 0, "a": 7, "é": 9, "z": 100, None: 3}, {}])
def test_targets(spark, sizes):
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    sources = spark.createDataFrame([(s, sizes[s], i) for i, s in enumerate(order)], "s string, words bigint, pos int")
    assert {r["s"]: r["target"] for r in M.targets(sources).collect()} == pytest.approx(by_hand(sizes) if sizes else {})


def test_route_overlap():
    """Documents of two sources fill the needy one; repetitions only where nothing else is left."""
    given = M.route({("a",): 10, ("a", "b"): 50, ("b",): 20}, {"a": 30, "b": 40})
    assert sum(given.values()) == 70 and all(given[p] <= n for p, n in {("a",): 10, ("a", "b"): 50, ("b",): 20}.items())
    assert M.route({("a",): 10, ("b",): 100}, {"a": 25, "b": 50}) == {("a",): 25, ("b",): 50}
    assert M.route({("a",): 10}, {"a": 100}) == {("a",): 30}


def test_mix(spark, docs, empty):
    got = M.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    rows = [(r[0], len((r[1] or "").split()), r[3]) for r in messy()]
    sizes: dict = {}
    for _, n, s in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = by_hand(sizes)
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((d or -1, n) for d, n, _ in rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    again = M.mix(docs.repartition(5)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert sorted(got, key=str) == sorted(again, key=str)
    assert M.mix(empty).count() == 0


def test_mix_near_targets(spark):
    rows = [(k, " ".join(["w"] * (1 + k * 7 % 40)), f"s{k % 5}" if k % 3 else "s0") for k in range(3000)]
    got = M.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t"))
    for r in got.collect():
        assert abs(r["n"] - r["t"]) <= 2


@pytest.mark.parametrize("copies", [1000, 7])
def test_mix_repeated_rows(spark, copies):
    """Of equal rows as many are taken as the target has room for."""
    rows = [(5, " ".join(["w"] * 10), "a")] * copies + [(k, " ".join(["w"] * 10), "b") for k in range(100, 500)] + [(None, "x y z", None)] * 3
    got = M.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)).cache()
    assert got.count() == len(rows) and got.filter("taken > 3 * size").count() == 0
    want = by_hand({"a": 10 * copies, "b": 4000, None: 9})
    for r in got.groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t")).collect():
        assert r["t"] == pytest.approx(want[r["source"]]) and abs(r["n"] - r["t"]) < (3 if r["source"] is None else 10)


def test_mix_by_brute_force(spark):
    """The taken documents are those that a plain walk in seeded order takes."""
    rows = [(k, " ".join(["w"] * (1 + k * k % 90)), f"s{k % 3}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r for r in M.mix(df).collect()}
    hashed = {r[0]: r[1] for r in df.select("doc_id", F.xxhash64(F.lit(7), "doc_id")).collect()}
    for source in ("s0", "s1", "s2"):
        own = [k for k, _, s in rows if s == source]
        n = {k: 1 + k * k % 90 for k in own}
        rest = round(got[own[0]]["target"])
        floor, rest = divmod(rest, sum(n.values()))
        own.sort(key=lambda k: ((hashed[k] >> 20) % M.CELLS, hashed[k], n[k], k))
        more, i = set(), 0
        while i < len(own) and n[own[i]] <= rest:
            more.add(own[i])
            rest -= n[own[i]]
            i += 1
        by_size: dict = {}
        for k in own[i + 1 :]:
            by_size.setdefault((n[k], hashed[k] % M.SPARES), k)
        for k in sorted(by_size.values(), key=lambda k: (n[k], (hashed[k] >> 20) % M.CELLS, hashed[k], k), reverse=True):
            if n[k] <= rest:
                more.add(k)
                rest -= n[k]
        assert {k: got[k]["repeats"] for k in own} == {k: floor + (k in more) for k in own}


def test_mix_does_not_depend_on_how_the_plan_is_joined(spark):
    """Many patterns or few, broadcast or not: sizes, targets and choices are those of full memberships."""
    rows = [(k, " ".join(["w"] * (1 + k % 9)), [f"s{j}" for j in range(4) if (k >> j) & 1]) for k in range(320)] + [(1000 + k, "a b c", ["lone"]) for k in range(9)] + [(2000, "x y", None), (2001, None, ["s1", None])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, own array<string>")
    few, many = (sorted(map(tuple, M.mix(df, memberships=F.col("own"), max_patterns=most).select("doc_id", "size", "source_size", "target", "repeats", "taken").collect())) for most in (3, 1000))
    assert few == many and len(few) == len(rows)
    sizes: dict = {}
    for _, t, own in rows:
        for s in own or []:
            sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, total = by_hand(sizes), sum(len((t or "").split()) for _, t, own in rows if own)
    scale = total / sum(sizes.values())
    told = {k: own for k, _, own in rows}
    for k, size, source_size, target, _, taken in few:
        if not told[k]:
            assert (source_size, target, taken) == (None, None, 0)
        else:
            first = min(told[k], key=lambda s: (s is None, s or ""))
            assert source_size == sizes[first] and target == pytest.approx(want[first] * scale) and taken <= 3 * size
    assert abs(sum(r[5] for r in few) - total) <= 60


def test_mix_flow_of_parts_is_the_flow_of_all(spark):
    """What patterns give, part by part, equals one flow over everything."""
    import random

    rng = random.Random(5)
    patterns = {tuple(sorted(rng.sample(range(10 * g, 10 * g + 6), rng.choice([1, 2, 3])))): rng.randrange(1, 60) for g in range(4) for _ in range(25)} | {(99,): 7}
    quotas = {s: float(rng.randrange(20, 200)) for p in patterns for s in p}
    whole = M.route(patterns, quotas)
    made = spark.createDataFrame([("-".join(map(str, p)), [str(s) for s in p], n) for p, n in patterns.items()], "__weft_p string, __weft_m array<string>, words bigint")
    sources = spark.createDataFrame([(str(s), s, q) for s, q in quotas.items()], "s string, pos int, target double")
    got = {r["__weft_p"]: r["given"] for r in M._given(made, sources, Scratch(spark, "flow"), 3).collect()}
    assert got == {"-".join(map(str, p)): n for p, n in whole.items()}


def test_mix_of_sources_with_odd_names(spark):
    """Names that look like the join of two others are sources of their own."""
    rows = [(1, "a b", ["a", "b"]), (2, "a b c", ["a\u0001sb"]), (3, "d", ["z"]), (4, "e f", [None])]
    got = M.mix(spark.createDataFrame(rows, "doc_id bigint, text string, own array<string>"), memberships=F.col("own")).collect()
    assert {r["doc_id"]: r["source_size"] for r in got} == {1: 2, 2: 3, 3: 1, 4: 2} and len(got) == 4


def test_mix_of_many_sources(spark):
    """Thousands of sources: targets by the same shares as by hand, and every source near its own."""
    df = spark.range(30_000).selectExpr("id AS doc_id", "repeat('w ', CAST(1 + id % 23 AS INT)) AS text", "CAST(pow(id, 0.85) AS STRING) AS source")
    got = M.mix(df, max_patterns=100).groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t"), F.sum("size").alias("size")).collect()
    want = by_hand({r["source"]: r["size"] for r in got})
    assert len(got) > 5000
    assert all(r["t"] == pytest.approx(want[r["source"]]) and abs(r["n"] - r["t"]) < 24 for r in got)


def test_route_of_many_patterns():
    """Thousands of patterns are routed in about their number of steps, and every quota that can be met is."""
    import random
    import time

    rng = random.Random(3)
    patterns = {tuple(sorted(rng.sample(range(40), rng.choice([1, 2, 3])))): rng.randrange(1, 500) for _ in range(20_000)}
    total = sum(patterns.values())
    started = time.time()
    given = M.route(patterns, {s: total / 40 for s in range(40)})
    assert abs(sum(given.values()) - total) <= 40 and time.time() - started < 60
    assert max(given[p] / n for p, n in patterns.items()) <= 3


# Chat


def test_chat_round_trip(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", said), (1, 1, "assistant", "\\" + said + "\\\\<s>\n</s>\n"), (1, 2, "a b/ü\n", None), (2, 5, None, "x"), (2, 5, "assistant", "y"), (2, 5, "assistant", "y"), (None, 0, "assistant", "𝄞é"), (3, 0, "assistant", "long " * 40000), (4, 0, "user", "\\"), (4, 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    formatted = C.format_conversations(C.conversation_events(df))
    got = {r["conv_id"]: r for r in C.digest(formatted).collect()}
    spans = {r["conv_id"]: r for r in formatted.collect()}
    for conv in (1, 2, 3, 4, None):
        turns = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        every = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        text = spans[conv]["formatted"]
        assert r["formatted_chars"] == len(text)
        masked = "".join(text[s["start"] : s["start"] + s["length"]] for s in spans[conv]["loss_spans"])
        assert re.sub(r"\\(</?s>|\[/?INST\])", r"\1", masked) == loss
    assert C.digest(C.format_conversations(C.conversation_events(df.filter("false")))).count() == 0


def fold(spark, events):
    df = spark.createDataFrame(events, "conv_id bigint, message bigint, seq bigint, kind string, role string, text string")
    return sorted(tuple(r) for r in C.fold_events(df).select("message", "role", "text").collect())


def test_chat_events(spark):
    events = [(1, 0, 1, "message", "user", "hi"), (1, 1, 2, "delta", "assistant", "a"), (1, 1, 3, "delta", "assistant", "b"), (1, 1, 4, "regenerate", "assistant", None), (1, 1, 6, "delta", "assistant", "d"), (1, 1, 5, "delta", "assistant", "c"), (1, 0, 7, "edit", "user", "hello"), (1, 2, 8, "message", "user", "gone"), (1, 2, 9, "retract", None, None)]
    assert fold(spark, events) == [(0, "user", "hello"), (1, "assistant", "cd")]


def test_chat_odd_events(spark):
    """Null and tied sequence numbers, unknown kinds, and events after a retraction."""
    assert fold(spark, [(1, 0, None, "delta", "u", "a"), (1, 0, None, "delta", "u", "b"), (1, 0, 0, None, "u", "c")]) == [(0, "u", "abc")]
    assert fold(spark, [(1, 0, None, "message", "u", "lost"), (1, 0, 3, "edit", "u", "x"), (1, 0, 3, "delta", "u", "y"), (1, 0, 3, "what", "u", "a")]) == [(0, "u", "xay")]
    assert fold(spark, [(1, 0, 1, "message", "u", "x"), (1, 0, 2, "retract", None, None), (1, 0, 3, "delta", "u", "y")]) == []
    assert fold(spark, [(1, 0, 1, "message", "u", "x"), (1, 0, 2, "retract", None, None), (1, 0, 3, "edit", "u", "y")]) == [(0, "u", "y")]
    assert fold(spark, [(1, 0, 2, "edit", "u", "x"), (1, 0, 2, "retract", "u", None)]) == []


def test_chat_log_has_every_kind(spark):
    """The log of plain turns streams, regenerates and edits them; folding gives the same turns, copies included."""
    rows = [(k % 3, k % 7, "user" if k % 2 else None, f"{k % 20} 𝄞" * (k % 90) or None) for k in range(200)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    events = C.conversation_events(df, delta=10)
    kinds = {r["kind"]: r["n"] for r in events.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert set(kinds) == {"message", "delta", "regenerate", "edit"} and kinds["delta"] > 1000
    got = C.fold_events(events).select("conv_id", "message.turn", "role", "text").collect()
    assert sorted(tuple(r) for r in got) == sorted((c, t, r or "", x or "") for c, t, r, x in rows)
    plan = C.format_conversations(events)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(conv_id" in plan and "message" in plan.split("hashpartitioning(conv_id", 2)[2][:60] + plan.split("hashpartitioning(conv_id", 2)[1][:60]
