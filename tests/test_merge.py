import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from beatwire.operators import merge as mg
from beatwire.operators import select as sel


def table(spark, rows):
    return spark.createDataFrame(rows, "ord long, url string, v string")


def kept(df):
    return sorted(((r.ord, r.url, r.v) for r in df.collect()), key=repr)


def test_newest_row_of_an_address_stays(spark):
    new = table(spark, [(1, "a", "n1"), (2, None, "n2"), (3, None, "n3"), (4, "a", "n4")])
    old = table(spark, [(1, "a", "o1"), (2, "b", "o2"), (3, None, "o3")])
    for cap in (None, 500, 20_000):
        assert kept(mg.merge_batch(new, old, cap=cap)) == [
            (1, "a", "n1"), (2, "b", "o2"), (2, None, "n2")]


def test_places_that_repeat_or_are_missing(spark):
    """The cap changes how many rows stay, never which row of an address."""
    new = table(spark, [(0, "a", "newA"), (0, "b", "newB"), (None, "c", "newC"), (1, None, "x")])
    old = table(spark, [(0, "a", "oldA"), (0, "d", "oldD"), (None, "e", "oldE"), (0, "f", "oldF")])
    whole = mg.merge_batch(new, old, cap=None)
    assert kept(whole) == kept(table(spark, [
        (0, "b", "newB"), (0, "a", "newA"), (None, "c", "newC"), (1, None, "x"),
        (0, "d", "oldD"), (None, "e", "oldE"), (0, "f", "oldF")]))
    order = mg.merge_order(whole)
    for cap in (1, 3, 5, 500, 20_000):
        assert kept(mg.merge_batch(new, old, cap=cap)) == kept(whole.orderBy(*order).limit(cap))


def test_without_addresses_nothing_is_merged_away(spark):
    new = spark.createDataFrame([(i, "t") for i in range(3)], "ord long, text string")
    assert mg.merge_batch(new, None).count() == 3
    assert mg.merge_batch(new, new).count() == 6


def test_merge_with_itself_adds_nothing(spark):
    new = table(spark, [(i, f"u{i}", "x") for i in range(20)])
    assert kept(mg.merge_batch(new, new)) == kept(new)


def test_cap_takes_new_rows_first(spark):
    new = table(spark, [(i, f"n{i}", "new") for i in range(4)])
    old = table(spark, [(i, f"o{i}", "old") for i in range(501)])
    got = mg.merge_batch(new, old).collect()
    assert len(got) == 500 and sum(r.v == "new" for r in got) == 4
    assert max(r.ord for r in got if r.v == "old") == 495


def test_first_run(spark):
    new = table(spark, [(1, "a", "x"), (2, "a", "y")])
    assert mg.merge_batch(new, None).count() == 1
    assert mg.merge_batch(new, None, first_run_raw=True).count() == 2


def test_hot_key_is_cut_before_the_shuffle(spark):
    url = F.when(F.col("id") % 3 > 0, F.col("id").cast("string"))      # a third without
    df = spark.range(9_000).select(F.col("id").alias("ord"), url.alias("url"))
    plan = mg.first_per(df, ["url"], [F.asc("ord")])
    text = plan._jdf.queryExecution().executedPlan().toString()
    final, exchange, partial = (text.index(p) for p in ("Final", "Exchange", "Partial"))
    assert final < exchange < partial                # printed from the last step to the first
    assert plan.count() == 6_001


def test_caps(spark):
    rows = [("f0", 0, 0, "a"), ("f0", 0, 1, "a"), ("f0", 0, 2, "b"), ("f0", 0, 3, "c"),
            ("f1", 1, 0, "b"), ("f1", 1, 1, "d")]
    df = spark.createDataFrame(rows, "feed string, fr int, ord int, url string")

    def run(how):
        got = mg.cap_dedupe(df, "feed", "url", 3, "fr", "ord", how).collect()
        return sorted((r.feed, r.ord) for r in got)

    assert run("cap_first") == [("f0", 0), ("f0", 2), ("f1", 1)]     # N - 1 from f0
    assert run("dedupe_first") == [("f0", 0), ("f0", 2), ("f0", 3), ("f1", 0), ("f1", 1)]
    with pytest.raises(ValueError):
        run("other")


def test_union_and_fallback(spark):
    a = spark.createDataFrame([(1, "x")], "id int, s string")
    b = spark.createDataFrame([(2,)], "id int")
    both = mg.union_sources(a, b).collect()
    assert sorted((r.id, r.s, r.source_rank) for r in both) == [(1, "x", 0), (2, None, 1)]
    assert mg.with_fallback(a, [b, b.limit(0)]).collect() == b.collect()
    assert mg.with_fallback(None, []) is None
    assert mg.with_fallback(a, [b.limit(0)]) is a
    five = spark.range(5)
    assert mg.with_fallback(five, [a]) is five


def test_reports(spark):
    df = spark.createDataFrame(
        [(1, "s1", "2024-01-02", "en"), (2, "s2", None, "hi"), (3, "s1", "2024-02-01", None),
         (4, None, "2024-02-01", "xx")], "ord int, source string, date string, lang string")
    feed = sel.live_feed(df, "ord", n=3).collect()
    assert [r.ord for r in feed] == [3, 4, 1]
    assert (feed[0].n_shown, feed[0].n_total) == (3, 4)
    assert sel.live_feed(df, "ord").first().n_shown == 4
    assert [r.source for r in sel.source_options(df).collect()] == ["All Sources", "s1", "s2"]
    assert sel.filter_source(df).count() == 4
    assert sel.filter_source(df, "s1").count() == 2
    routed = sel.route_language(df)
    assert {r.ord: r.route for r in routed.collect()} == {
        1: "general", 2: "indic", 3: "general", 4: "general"}
    assert sel.route_language(df.drop("lang")).where("route = 'general'").count() == 4
    assert sel.route_or_all(routed, "indic", 1).count() == 1
    assert sel.route_or_all(routed, "indic", 2).count() == 4
    assert [r.ord for r in sel.preview(df, "ord", 2).collect()] == [1, 2]
    text = df.withColumn("clean_text", F.repeat(F.lit("x"), 80))
    assert [len(r.sample) for r in sel.sample_records(text, "ord").collect()] == [70] * 3


def test_claim_length(spark):
    df = spark.createDataFrame([(1, "x" * 49), (2, "x" * 50), (3, None)], "id int, text string")
    ok, rejected = sel.split_claims(df)
    assert [r.id for r in ok.collect()] == [2]
    assert sorted(r.id for r in rejected.collect()) == [1, 3]


@pytest.mark.parametrize("k", [1, 150, 5_000, 50_000])
def test_large_caps_without_sorting_a_group_in_one_task(spark, k):
    """One source holds a third of all rows, another is null; order with ties and nulls."""
    df = spark.range(0, 30_000, 1, 6).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 30 == 1, None)
        .otherwise(F.concat(F.lit("s"), F.col("id") % 200)).alias("source"),
        F.when(F.col("id") % 17 > 0, F.col("id") * 7919 % 1_000).alias("ord"))
    order = [F.asc_nulls_last("ord"), F.desc("id")]
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        first = mg.first_many(df, ["source"], order, k)
        got = {r.id for r in first.collect()}
        ranges = [r["count"] for r in first.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    w = Window.partitionBy("source").orderBy(*order)
    want = df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    assert got == {r.id for r in want.collect()}
    assert first.columns == df.columns
    assert max(ranges) <= 15_000  # of four ranges; the hot source alone has 10,000 rows


def test_first_per_changes_its_plan_beyond_what_spark_cuts(spark):
    df = spark.createDataFrame([("a", i) for i in range(3_000)] + [(None, 1)], "g string, i long")
    for k in (1_000, 1_001):
        got = mg.first_per(df, ["g"], [F.asc("i")], k)
        assert got.count() == k + 1
        assert ("Window" in got._jdf.queryExecution().optimizedPlan().toString()) == (k == 1_000)
    empty = mg.first_per(df.limit(0), ["g"], [F.asc("i")], 5_000)
    assert empty.collect() == [] and empty.columns == ["g", "i"]
