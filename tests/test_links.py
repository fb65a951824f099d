from pyspark.sql import functions as F

from signalspark.functions.fetching import absolute_url

BASE = "https://Example.org/a/b/c.html?q=1"
LINKS = {
    "d": "https://example.org/a/b/d", "./d": "https://example.org/a/b/d", "../d": "https://example.org/a/d", "../../../../d": "https://example.org/d", "..": "https://example.org/a/", ".": "https://example.org/a/b/",
    "/x/./y/../z/": "https://example.org/x/z/", "/x/%2E%2e/y": "https://example.org/y", "//CDN.net": "https://cdn.net/", "HTTP://H.org:80/P/../Q#F": "http://h.org/Q#F", "http://h.org:8080?a=/../b": "http://h.org:8080/?a=/../b",
    "?p=../x": "https://example.org/a/b/c.html?p=../x", "#top": "https://example.org/a/b/c.html#top", "/...": "https://example.org/...", "/a//b": "https://example.org/a//b", "mailto:a@b.c": None, "": None, "https://me@H.org/a": "https://me@H.org/a",
}


def test_links_are_resolved(spark):
    rows = spark.createDataFrame([(k,) for k in LINKS] + [(None,)], "link string").select("link", absolute_url(F.col("link"), F.lit(BASE)).alias("full")).collect()
    assert {r["link"]: r["full"] for r in rows} == LINKS | {None: None}
