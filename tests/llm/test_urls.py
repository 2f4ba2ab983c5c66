import numpy as np
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from nodeglass.llm import urls


@given(st.integers(0, 2000), st.integers(0, 3000), st.integers(0, 5))
def test_cascade_is_exact(listed, others, seed):
    keys = np.random.default_rng(seed).permutation(1 << 20)[:listed + others].astype(np.int64) * 7919
    levels = urls.build_cascade(keys[:listed], keys[listed:])
    assert urls.ask_cascade(levels, keys).tolist() == [True] * listed + [False] * others


def test_membership_in_several_groups(spark, monkeypatch):
    monkeypatch.setattr(urls, "SHARD_KEYS", 50)
    monkeypatch.setattr(urls, "MAX_BYTES", 300)
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    listed = keys.where("id % 7 = 0").select("key")
    out = urls.with_membership(keys, "key", keys.select("key"), listed.unionByName(spark.createDataFrame([("out",), (None,)], "key string")))
    assert out.where("listed <> (id % 7 = 0)").count() == 0 and out.count() == 3000


def test_verdicts(spark):
    rows = [
        (1, "http://a.com/x", "com/", "allow"), (2, "HTTP://WWW.Example.COM/en/1?q#f", "www.example.com/en/", "allow"),
        (3, "http://x.example.com/en/", "example.com/en/", "block"), (4, "http://example.com", None, "allow"),
        (5, "https://n.net/fr/a", "net/fr/", "block"), (6, "https://n.net/de/a", None, "allow"), (7, None, None, "allow"),
        (8, "no scheme", None, "allow"), (9, "x://bad.org/en/", None, "block"), (9, "x://bad.org/en/", None, "block"),
        (10, "a://b://c.com/d", None, "allow"), (None, "", None, "allow"), (11, "http://xcom/y", None, "allow"),
    ]
    pages = spark.createDataFrame([(r[0], r[1], "h", "v") for r in rows], "page_id long, url string, host string, verdict string")
    out = urls.judge_urls(pages, spark.createDataFrame([("bad.org",), ("unused.org",), (None,)], "key string"))
    got = [(r["page_id"], r["url"], r["rule"], r["verdict"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)
    empty = urls.judge_urls(pages.where("page_id < 0"), spark.createDataFrame([], "key string"))
    assert empty.count() == 0


def test_split(spark):
    host, path = urls.split_url(F.col("url"))
    rows = spark.createDataFrame([("http://A.b:80/P/q?x",), ("x://h#f",), ("://h/?",), ("h/p",)], "url string").select(host, path).collect()
    assert [tuple(r) for r in rows] == [("a.b:80", "/P/q"), ("h", ""), ("h", "/"), ("", "")]
