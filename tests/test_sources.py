import pytest
from pyspark.sql import functions as F

from beatwire.dims import outlet_table
from beatwire.functions.dates import date_is_known, feed_date
from beatwire.plans.batch import clean_articles
from beatwire.schemas import ARTICLE, ensure_columns, require_columns
from beatwire.sources import feeds, tables
from beatwire.sources.outlets import attach_source

FEED = """<?xml version="1.0"?><rss><channel><title>Feed</title>
<item><title> First &amp; last </title><description>Body one</description>
<link>http://example.com/1</link><pubDate>Mon, 01 Jan 2024 02:00:00 +0530</pubDate></item>
<item><title>Second</title><link>http://example.com/2</link>
<updated>2024-02-03T10:00:00Z</updated></item>
<item><description>only this</description></item>
</channel></rss>"""


ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>Feed</title>
<entry><title type="text">One</title><link rel="self" href="http://example.com/self"/>
<link href="http://example.com/1"/><summary>Body</summary><published>2024-01-01T23:00:00-02:00</published></entry>
<entry><title>Two</title><link rel="enclosure" href="http://example.com/2"/><content>All</content>
<updated>2024-02-03T10:00:00Z</updated></entry></feed>"""


def test_feed_files(spark, tmp_path):
    (tmp_path / "source=The Hindu").mkdir()
    (tmp_path / "source=The Hindu" / "feed.xml").write_text(FEED)
    items, broken = feeds.read_feeds(spark, str(tmp_path))
    got = feeds.entries_to_articles(items, F.col("source")).orderBy("ord").collect()
    assert [(r.title, r.text, r.url, r.source) for r in got] == [
        ("First & last", "First & last. Body one", "http://example.com/1", "The Hindu"),
        ("Second", "Second.", "http://example.com/2", "The Hindu"),
        ("", ". only this", "", "The Hindu")]
    assert [r.date for r in got[:2]] == ["2023-12-31", "2024-02-03"]      # UTC
    assert broken.collect() == []


def test_atom_files(spark, tmp_path):
    (tmp_path / "atom.xml").write_text(ATOM)
    items, _ = feeds.read_feeds(spark, str(tmp_path / "atom.xml"), "atom")
    got = feeds.entries_to_articles(items, "x").orderBy("ord").collect()
    assert [(r.title, r.text, r.url, r.date) for r in got] == [
        ("One", "One. Body", "http://example.com/1", "2024-01-02"),
        ("Two", "Two. All", "http://example.com/2", "2024-02-03")]


def test_other_elements_and_broken_items(spark):
    df = spark.createDataFrame([
        (1, "<item><title>a</title><encoded>whole</encoded><date>2024-03-04T00:00:00Z</date></item>"),
        (2, "<item><title>cut"), (3, "no xml at all")], "id int, xml string")
    items, broken = feeds.parse_items(df, "xml")
    r = feeds.entries_to_articles(items, "x").first()
    assert (r.id, r.text, r.date) == (1, "a. whole", "2024-03-04")
    assert sorted(r.id for r in broken.collect()) == [2, 3]


def test_feed_dates(spark):
    cases = {("Tue, 2 Apr 2024 23:59:59 GMT", None): "2024-04-02",
             ("garbage", "2024-05-06 07:08:09"): "2024-05-06",
             ("Wed, 03 Apr 2024 00:10 +0000", None): "2024-04-03",
             (None, "2024-01-31T23:30:00-02:00"): "2024-02-01",
             ("Mon, 01 Jan 2024 02:00 IST", None): "2023-12-31",
             ("Monday, 01 Jan 2024 10:00:00 EST", None): "2024-01-01",
             ("01 Jan 24 23:30:00 PST", None): "2024-01-02",
             ("Mon, 01 Jan 2024 10:00:00 XYZ", None): None, (None, None): None}
    df = spark.createDataFrame(list(cases), "p string, u string")
    now = F.lit("2024-12-31 01:00:00").cast("timestamp")
    got = df.select(feed_date(F.col("p"), F.col("u"), now), date_is_known(F.col("p"), F.col("u")))
    assert [tuple(r) for r in got.collect()] == [
        (day or "2024-12-31", day is not None) for day in cases.values()]


def test_missing_tables(spark, tmp_path):
    assert tables.read_articles(spark, str(tmp_path / "none")) is None
    assert tables.read_baseline(spark, str(tmp_path / "none.csv"), ["a"]) is None
    assert tables.last_run(spark, str(tmp_path / "log")).first().last_updated == "Never"


def test_csv_round_trip(spark, tmp_path):
    rows = [('A "quoted", title', "two\nlines, ಕನ್ನಡ", "2026-03-25", "http://u/1", "Prajavani"),
            ("b", None, "bad", "http://u/2", None)]
    df = spark.createDataFrame(rows, ARTICLE)
    path = str(tmp_path / "csv")
    assert tables.write_articles(df, path, fmt="csv")
    back = tables.read_articles(spark, path, fmt="csv")
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    good, bad = tables.read_articles_checked(spark, path)
    assert good.count() == 2 and bad.count() == 0
    (tmp_path / "broken.csv").write_text("title,text,date,url,source\na,b,c,d,e\nf,g\n")
    good, bad = tables.read_articles_checked(spark, str(tmp_path / "broken.csv"))
    assert [r.title for r in good.collect()] == ["a"]
    assert [r[0] for r in bad.collect()] == ["f,g"]


def test_parquet_by_month(spark, tmp_path):
    df = spark.createDataFrame([("t", "x", d, "u", "s") for d in ("2024-01-05", "2024-02-05", "?")],
                               ARTICLE)
    path = str(tmp_path / "parquet")
    assert tables.write_articles(df, path)
    assert {p.name for p in (tmp_path / "parquet").glob("month=*")} == {
        "month=2024-01", "month=2024-02", "month=__HIVE_DEFAULT_PARTITION__"}
    assert tables.read_articles(spark, path).count() == 3
    assert not tables.write_articles(df.limit(0), str(tmp_path / "no"), only_if_any=True)
    assert not (tmp_path / "no").exists()


def test_run_log(spark, tmp_path):
    log = str(tmp_path / "log")
    for ts in ("2024-01-01 10:00:00", "2024-03-01 10:00:00", "2024-02-01 10:00:00"):
        tables.record_run(spark, log, ts)
    assert tables.last_run(spark, log).first().last_updated == "2024-03-01 10:00:00"


def test_baseline(spark, tmp_path):
    (tmp_path / "s.csv").write_text("date,theft\n2024-01-31,5\nbad,6\n")
    got = tables.read_baseline(spark, str(tmp_path / "s.csv"), ["theft"]).collect()
    assert [(str(r.date), r.theft) for r in got] == [("2024-01-31", 5.0), ("None", 6.0)]


def test_schema_checks(spark):
    df = spark.createDataFrame([("t",)], "title string")
    with pytest.raises(ValueError, match="text"):
        require_columns(df, ["title", "text"])
    with pytest.raises(ValueError):
        clean_articles(df)
    full = ensure_columns(df, ARTICLE, {"source": "unknown"})
    assert full.first().asDict() == {"title": "t", "text": None, "date": None, "url": None,
                                     "source": "unknown"}


def test_clean_articles(spark):
    df = spark.createDataFrame([("a", "ok text", "ta"), ("b", "தமிழ்", "ta"), ("c", None, None)],
                               "title string, text string, language string")
    assert [(r.title, r.lang) for r in clean_articles(df).collect()] == [("a", "en")]
    assert [r.lang for r in clean_articles(df, keep_language=True).collect()] == ["ta"]


def test_outlets(spark):
    df = spark.createDataFrame([("Sakshi",), ("Amar Ujala",), ("nobody",)], "source string")
    got = {r.source: (r.kind, r.language) for r in attach_source(df, outlet_table(spark)).collect()}
    assert got == {"Sakshi": ("anchors", "te"), "Amar Ujala": ("anchors", "hi"),
                   "nobody": (None, None)}


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_rows_know_their_place_in_the_file(spark, tmp_path, fmt):
    """An unsorted file that Spark splits, and a second one behind it."""
    days = [f"2023-{1 + i * 7 % 12:02d}-{1 + i * 11 % 28:02d}" for i in range(3_000)]
    path = str(tmp_path / "baseline")
    for part in (0, 1):
        rows = [(d, float(part * 10_000 + i)) for i, d in enumerate(days)]
        df = spark.createDataFrame(rows, "date string, murder double").coalesce(1)
        df.write.mode("append").option("header", True).format(fmt).save(f"{path}/part={part}")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "4096")
    try:
        df = tables.read_baseline(spark, path, ["murder"], fmt)
        if fmt == "csv":
            assert df.rdd.getNumPartitions() > 4
        got = [int(r.murder) for r in df.orderBy("row_number").collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == [part * 10_000 + i for part in (0, 1) for i in range(3_000)]


def test_feeds_of_either_kind(spark, tmp_path):
    rss = "<rss><channel><item><title>r</title><link>http://r/1</link></item></channel></rss>"
    atom = ('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>a</title>'
            '<link href="http://a/1"/></entry></feed>')
    for source, xml in (("one", rss), ("two", atom)):
        folder = tmp_path / f"source={source}"
        folder.mkdir()
        (folder / "feed.xml").write_text(xml)
    items, broken = feeds.read_feeds(spark, str(tmp_path), "any")
    assert sorted((r.source, r.title, r.link) for r in items.collect()) == [
        ("one", "r", "http://r/1"), ("two", "a", "http://a/1")]
    assert broken.collect() == []
