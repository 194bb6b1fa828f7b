from pyspark.sql import functions as F

from beatwire.dims import outlet_table
from beatwire.plans.collect import collect_articles

LONG = "A headline that is quite long enough"


def test_collect(spark):
    items = spark.createDataFrame(
        [(0, "The Hindu", "t0", "s", "http://u/0", "Mon, 01 Jan 2024 10:00:00 +0000", None),
         (1, "The Hindu", "t1", "s", "http://u/0", None, None),
         (2, "The Hindu", "t2", "s", "http://u/2", None, None),
         (0, "NDTV India", "n0", "s", "http://u/0", None, None)],
        "ord int, source string, title string, description string, link string, "
        "pubDate string, updated string")
    heads = "".join(f"<h2><a href='/k{i}'>{LONG} {i // 2}</a></h2>" for i in range(8))
    links = "".join(f"<a href='/l{i // 2}' title='{LONG} {i}'>x</a>" for i in range(8))
    short = "".join(f"<a href='/s{i}'>{'s' * (19 + i)}</a>" for i in range(4))
    pages = spark.createDataFrame(
        [(1, "https://www.prajavani.net/", heads), (2, "https://www.bhaskar.com/national/", links),
         (3, "https://www.sakshi.com/national", short + links),
         (4, "https://unknown.example.org/", heads)], "page_id long, url string, html string")
    got = collect_articles(items, pages, outlet_table(spark), F.lit("2024-05-05"), cap=2)
    rows = sorted(((r.source_rank, r.title, r.url, r.date, r.language) for r in got.collect()),
                  key=repr)
    assert rows == [
        (0, "n0", "http://u/0", "2024-05-05", None),
        # of the two first items of The Hindu both repeat an address of an earlier feed
        (1, f"{LONG} 0", "https://www.prajavani.net/k0", "2024-05-05", None),
        (1, f"{LONG} 1", "https://www.prajavani.net/k2", "2024-05-05", None),
        (2, f"{LONG} 0", "https://www.bhaskar.com/l0", "2024-05-05", "hi"),
        (2, f"{LONG} 2", "https://www.bhaskar.com/l1", "2024-05-05", "hi"),
        (3, "s" * 21, "https://www.sakshi.com/s2", "2024-05-05", "te"),
        (3, "s" * 22, "https://www.sakshi.com/s3", "2024-05-05", "te"),
    ]
