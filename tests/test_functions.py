from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftline.functions import ids, text, tokens
from weftline.sources import files


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("url", "name"),
    [("http://h/x/a%20b.md?q=1", "a b.md"), ("http://h/", "unknown"), ("/p/q.txt", "q.txt"), ("", "unknown"), (None, "unknown"), ("http://h/a+b", "a+b"), ("https://h/bad%zz", "bad%zz"), ("dir/", "dir/"), ("HTTP://h/X.md#top", "X.md")],
)
def test_file_name(spark, url, name):
    assert one(spark, url, text.file_name) == name


def test_sanitize(spark):
    assert one(spark, "  a \n b\U0001f600￿'c\" ", lambda c: text.sanitize(c, True)) == "a bc"
    assert one(spark, " \n", text.sanitize) == ""
    assert one(spark, None, text.sanitize) == ""
    assert one(spark, " a  b ", text.sanitize_encoding) == " a  b "


def test_summary(spark):
    assert one(spark, "x" * 101, text.summary) == "x" * 100 + "..."
    assert one(spark, "x" * 100, text.summary) == "x" * 100
    assert one(spark, None, text.summary) == ""


@pytest.mark.parametrize(("n", "said"), [(-1, "0 B"), (0, "0 B"), (1023, "1023 B"), (1536, "1.5 KB"), (1 << 20, "1 MB"), (5 << 30, "5 GB"), (1 << 41, "2048 GB"), (102400, "100 KB")])
def test_file_size(spark, n, said):
    assert one(spark, n, text.format_file_size, "bigint") == said


def test_status_text(spark):
    rows = spark.createDataFrame([("Processing", "MergingEntities"), ("Processing", None), (None, "x"), ("Failed", "x"), ("Processing", "Other")], "s string, g string")
    assert [r[0] for r in rows.select(text.status_text(F.col("s"), F.col("g"))).collect()] == ["Merging Entities", "Processing", "Not Added", "Failed", "Other"]


def test_upload_name(spark):
    row = spark.createDataFrame([("my (old) file.v1.md", dt.datetime(2024, 1, 2, 3, 4, 5), "abcdef0123")], "n string, t timestamp, h string")
    assert row.select(text.upload_name(F.col("n"), F.col("t"), F.col("h"))).first()[0] == "my_old_file.v1_20240102030405_abcdef01.md"


def test_absolute_url(spark):
    assert one(spark, "/uploads/a.md", lambda c: text.absolute_url(c, "http://h/")) == "http://h/uploads/a.md"
    assert one(spark, "https://x/a", lambda c: text.absolute_url(c, "http://h/")) == "https://x/a"


def test_ids(spark):
    import hashlib
    import uuid

    assert one(spark, "a", lambda c: ids.prefixed_md5("doc-", c)) == "doc--0cc175b9c0f1b6a831c399e269772661"
    raw = bytearray(hashlib.sha256(b"kgname").digest()[:16])
    raw[6], raw[8] = raw[6] & 15 | 64, raw[8] & 63 | 128
    assert one(spark, "name", lambda c: ids.point_uuid("kg", c)) == uuid.UUID(bytes_le=bytes(raw)).hex
    assert one(spark, "name", lambda c: ids.point_id("kg", c)) == str(int.from_bytes(raw[:8], "little"))
    assert one(spark, None, lambda c: ids.args_md5(c, F.lit("b"))) == hashlib.md5(b"|b").hexdigest()


def test_tokens(spark):
    assert one(spark, " a b\n\tc ", tokens.token_count) == 3
    assert one(spark, None, tokens.token_count) == 0


def test_decode_bytes(spark):
    cases = [("é".encode(), "é"), (b"\xef\xbb\xbfhi", "hi"), ("你好".encode("gbk"), "你好"), ("hi".encode("utf-16"), "hi"), (b"", "")]
    rows = spark.createDataFrame([(i, bytearray(b)) for i, (b, _) in enumerate(cases)], "i int, b binary")
    assert {r["i"]: r["t"] for r in rows.select("i", files.decode_content(F.col("b")).alias("t")).collect()} == {i: t for i, (_, t) in enumerate(cases)}


def test_read_folders_and_tables(spark, tmp_path):
    (tmp_path / "docs" / "one").mkdir(parents=True)
    (tmp_path / "docs" / "one" / "SKILL.md").write_text("# a\nb")
    assert [tuple(r) for r in files.read_folders(spark, str(tmp_path / "docs")).collect()] == [("one.md", "# a\nb")]
    uploads = files.read_uploads(spark, str(tmp_path / "docs")).first()
    assert (uploads["file_name"], bytes(uploads["content"])) == ("SKILL.md", b"# a\nb")
    (tmp_path / "t.json").write_text('{"id": "a", "n": 1}\nbroken\n')
    assert [tuple(r) for r in files.read_table(spark, str(tmp_path / "t.json"), "id string, n int").collect()] == [("a", 1)]
    assert files.read_table(spark, str(tmp_path / "none.json"), "id string").count() == 0
    assert files.read_table(spark, str(tmp_path / "t.json"), "id string, n int", str(tmp_path / "kept")).count() == 1
    assert spark.read.text(str(tmp_path / "kept")).count() >= 1


def test_guessed_encodings():
    chinese = "\u9019\u662f\u4e00\u500b\u4e2d\u6587\u6a94\u6848\uff0c\u5b83\u7684\u7de8\u78bc\u4e0d\u660e"
    simple = "\u8fd9\u662f\u4e00\u4e2a\u4e2d\u6587\u6587\u4ef6\uff0c\u5b83\u7684\u7f16\u7801\u4e0d\u660e"
    for text, name in ((chinese, "big5"), (simple, "gbk"), ("un caf\u00e9 tr\u00e8s fort", "cp1252"), ("plain \u00e9t\u00e9 text", "utf-16-le"), ("plain \u00e9t\u00e9 text", "utf-16-be"), (chinese, "utf-8")):
        assert files.decode_bytes(text.encode(name)) == text, name
    assert files.decode_bytes(b"") == ""
