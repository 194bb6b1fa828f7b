import pytest
from pyspark.sql import functions as F

from beatwire.llm.q_url_filter import RULES
from beatwire.llm.rows import repeated
from beatwire.llm.url_filter import filter_urls

MORE = RULES + [("a.example.org", "/", "allow"), ("example.org", "/", "block"), (None, "/", "block"),
                ("Same.net", None, "allow"), ("same.net", "", "block"), ("x", "yz", "block")]
URLS = ["http://example.org/es/1", "http://m.Example.ORG/en/12?x=/es/", "http://example.org/en/2",
        "http://notexample.org/es/", "http://org/", "http://org", "http://example.org?/es/",
        "http://a.b.c.com/fr/", "http://a.com/de/#x", "http://com/de", "no scheme", None, "", "://",
        "http://a.example.org/es/", "http://same.net", "http://sub.same.net/p", "http://xy/z",
        "http://x/yz", "http://org:80/", "a://b://com/fr/", "http://example.org./es/",
        "http://" + "a." * 500 + "com/de/" + "p" * 20_000, "http://EXAMPLE.org/EN/1",
        "http://é.example.org/en/1"]


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    hits = []
    for rhost, rpath, verdict in rules:
        rhost, rpath = (rhost or "").lower(), rpath or ""
        if rhost and (host == rhost or host.endswith("." + rhost)) and path.startswith(rpath):
            hits.append((len(rhost + rpath), len(rhost), verdict == "block", rhost + rpath, verdict))
    best = max(hits, default=(0, 0, 0, None, default))
    return host, path, best[3], best[4]


@pytest.mark.parametrize("rules", [RULES, MORE, []])
def test_against_brute_force(spark, rules):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumns(
        {c: F.lit("clash") for c in ("host", "path", "rule", "digest", "m", "copy")})
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict)
           for r in filter_urls(pages, table).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(URLS)}


def test_repeated_rows_and_null_ids(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    rows = [(1, "http://org/")] * 3 + [(None, "http://com/de/")] * 2 + [(1, "http://a.com/fr/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = sorted((str(r.page_id), r.verdict) for r in filter_urls(pages, rules).collect())
    assert got == [("1", "allow")] * 4 + [("None", "block")] * 2
    assert filter_urls(pages.limit(0), rules).collect() == []


def test_repeated_rows_in_two_steps(spark):
    df = spark.createDataFrame([(1, 25_001), (2, 1), (3, 0), (4, 10_000)], "k int, m long")
    got = (repeated(df, "m").groupBy("k")
           .agg(F.count("*"), F.countDistinct("copy"), F.max("copy")).orderBy("k").collect())
    assert [tuple(r) for r in got] == [(1, 25_001, 25_001, 25_000), (2, 1, 1, 0),
                                       (4, 10_000, 10_000, 9_999)]


def test_query_equals_sql(spark, same_as_sql):
    same_as_sql(spark, "op6_url_filter")
