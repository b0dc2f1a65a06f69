from __future__ import annotations

import glob
import os

import pytest

from weftline.operators.buckets import BucketStore


def store(spark, tmp_path, buckets=8):
    return BucketStore(spark, str(tmp_path / "t"), "k string, n bigint, v string", ("k",), ("k", "n"), buckets)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, n bigint, v string")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def files(tmp_path):
    return set(glob.glob(str(tmp_path / "t/data/*/*/*.parquet")))


def test_replace_rewrites_only_touched_buckets(spark, tmp_path):
    s = store(spark, tmp_path)
    first = [(f"k{i}", i % 3, "old") for i in range(300)]
    s.append(frame(spark, *first))
    before = files(tmp_path)
    s.replace(frame(spark, ("k7", 1, "new"), ("new", 0, "new")), spark.createDataFrame([("k9", 0), ("k9", 5), ("none", 1)], "k string, n bigint"))
    want = sorted([r for r in first if r[:2] not in (("k7", 1), ("k9", 0))] + [("k7", 1, "new"), ("new", 0, "new")])
    assert rows_of(s.read()) == want
    made = files(tmp_path) - before
    touched = {os.path.basename(os.path.dirname(f)) for f in made}
    assert before < files(tmp_path) and 1 <= len(touched) <= 4
    # Other buckets still read their old files.
    live = {f.split("/t/")[1] for f in s.read().inputFiles()}
    assert {f.split("/t/")[1] for f in made} < live and len({f.split("/")[2] for f in live} - touched) >= 4
    assert s.vacuum() == 0 and rows_of(s.read()) == want
    s.rebucket(3)
    assert rows_of(s.read()) == want and len(s.manifest()["data"]) == 3
    assert s.vacuum() == 2 and rows_of(s.read()) == want and len(glob.glob(str(tmp_path / "t/manifest/*.json"))) == 1


def test_lookup_opens_only_its_buckets(spark, tmp_path):
    s = store(spark, tmp_path, 16)
    s.append(frame(spark, *((f"k{i}", i, "x") for i in range(500))))
    found = s.near(spark.createDataFrame([("k3",), ("k499",), ("none",), (None,), ("k3",)], "other string"), ("other",))
    assert rows_of(found) == [("k3", 3, "x"), ("k499", 499, "x")]
    assert 1 <= len(found.inputFiles()) <= 3 < len(s.read().inputFiles())
    many = s.near(spark.createDataFrame([(f"k{i}",) for i in range(100, 450)], "k string"))
    assert many.count() == 350
    assert s.near(spark.createDataFrame([], "k string")).count() == 0


def test_readers_see_whole_writes(spark, tmp_path):
    s = store(spark, tmp_path)
    assert rows_of(s.read()) == [] and s.vacuum() == 0
    s.append(frame(spark, ("a", 1, "x"), ("b", 1, "x")))
    held = s.read()
    s.replace(frame(spark, ("a", 1, "y"), ("b", 1, "y")))
    # A reader of before keeps what it saw; a new one sees all of the write.
    assert rows_of(held) == [("a", 1, "x"), ("b", 1, "x")] and rows_of(s.read()) == [("a", 1, "y"), ("b", 1, "y")]
    # A writer that is lost before it publishes has changed nothing.
    s._write(frame(spark, ("c", 1, "z")), 8)
    (tmp_path / "t/manifest/_lost.json").write_text("{")
    assert rows_of(s.read()) == [("a", 1, "y"), ("b", 1, "y")] and s.vacuum() == 2
    # Two writers that start from one manifest: the second is refused.
    m = s.manifest()
    s.append(frame(spark, ("d", 1, "w")))
    with pytest.raises(RuntimeError, match="another writer"):
        s._publish(m, 8, {})
    assert ("d", 1, "w") in rows_of(s.read())


def test_appends_and_compaction(spark, tmp_path):
    s = store(spark, tmp_path, 2)
    for i in range(5):
        s.append(frame(spark, ("a", i, "x"), ("b", i, "x"), ("c", i, "x")))
    want = sorted((k, i, "x") for k in "abc" for i in range(5))
    assert rows_of(s.read()) == want and max(len(v) for v in s.manifest()["data"].values()) == 5
    assert s.compact(3) == len(s.manifest()["data"]) and max(len(v) for v in s.manifest()["data"].values()) == 1
    assert rows_of(s.read()) == want and s.compact(3) == 0
    s.replace(frame(spark).limit(0), spark.createDataFrame([(k, i) for k in "abc" for i in range(5)], "k string, n bigint"))
    assert rows_of(s.read()) == [] and s.manifest()["data"] == {}


def test_files_have_bloom_filters_and_order(spark, tmp_path):
    import pyarrow.parquet as pq

    s = store(spark, tmp_path, 1)
    s.append(frame(spark, *((f"k{i * 7919 % 1000:04d}", i, "x") for i in range(1000))))
    keys = [k for f in sorted(files(tmp_path)) for k in pq.read_table(f).column("k").to_pylist()]
    assert keys == sorted(keys) and len(keys) == 1000
    # A bloom filter of the key column stands in each row group.
    assert all(pq.ParquetFile(f).metadata.row_group(0).column(0).statistics.has_min_max for f in files(tmp_path))


def test_label_index(spark, tmp_path):
    from weftline.operators.labels import LabelIndex

    names = ["Alice", "alibi", "Bob", "", "ali", "aliali", "日本語テキスト", "本語", None, "x%y_z"]
    nodes = spark.createDataFrame([(n, "person" if i % 2 else None) for i, n in enumerate(names)], "entity_id string, entity_type string")
    index = LabelIndex(spark, str(tmp_path / "labels"), 4)
    index.build(nodes)
    ids = lambda label: sorted(r["entity_id"] for r in index.match(label).collect())
    kept = [n for n in names if n is not None]
    for label in ("ali", "alia", "lice", "本語テ", "本", "person", "%y_", "zzz", "B", "perso"):
        assert ids(label) == sorted(n for i, n in enumerate(names) if n is not None and (label in n or (i % 2 and label == "person"))), label
    assert ids("*") == sorted(kept)
    index.put(spark.createDataFrame([("alibi", "thing"), ("malice", "person")], "entity_id string, entity_type string"))
    assert ids("ali") == ["ali", "aliali", "alibi", "malice"] and "alibi" not in ids("person") and ids("thing") == ["alibi"]
    index.remove(spark.createDataFrame([("alibi",), ("nobody",)], "entity_id string"))
    assert ids("ali") == ["ali", "aliali", "malice"] and ids("thing") == [] and "alibi" not in ids("*")
    opened = index.match("lice").inputFiles()
    assert 0 < len(opened) < len(index.store.read().inputFiles())
