"""The url query's rules are those of its contract, word for word."""

from __future__ import annotations

from weftline.llm import queries

#: block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/
CONTRACT = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
URLS = {
    "http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/71": ("example.com/en/7", "allow"), "http://b.net/de/": ("net/de/", "allow"),
    "http://a.example.net/de/81?x": ("example.net/de/8", "block"), "http://example.net/de/9": ("net/de/", "allow"), "http://b.org/es/x": ("org/es/", "block"), "http://b.org/de/": (None, "allow"),
}


def test_rules():
    assert dict(queries.RULES) == CONTRACT and len(queries.RULES) == len(CONTRACT)


def test_verdicts(spark, tmp_path):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id bigint, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op1_url_filter(spark, str(tmp_path)).orderBy("page_id").select("rule", "verdict").collect()
    assert [tuple(r) for r in got] == list(URLS.values())
