import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from beatwire.streaming.keyed_table import KeyedTable
from beatwire.streaming.streams import current_version, start_keyed_merge, stream_table

SCHEMA = "url string, title string, ord long"


def batch(spark, *rows):
    return spark.createDataFrame(list(rows) or [(None, None, None)], SCHEMA)


def state(table, version=None):
    return sorted(((r.url or "", r.title, r.arrived) for r in table.read(version).collect()))


@pytest.fixture()
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), buckets=64)


def test_newest_wins(spark, table):
    assert table.read() is None
    table.merge(batch(spark, ("a", "a0", 1), ("b", "b0", 2), ("b", "later in the batch", 3), (None, "n0", 4)))
    table.merge(batch(spark, ("a", "a1", 9), ("c", "c1", 1), (None, "n1", None)))
    assert state(table) == [("", "n1", 1), ("a", "a1", 1), ("b", "b0", 0), ("c", "c1", 1)]


def test_a_small_batch_writes_few_buckets(spark, table, tmp_path):
    many = spark.range(2_000).select(F.concat(F.lit("u"), "id").alias("url"), F.lit("old").alias("title"),
                                     F.col("id").alias("ord"))
    table.merge(many)
    first = table.manifest(0)
    touched = table.merge(many.where("id < 5").withColumn("title", F.lit("new")))
    second = table.manifest(1)
    assert len(first) == 64 and len(touched) <= 5
    assert {b for b in first if first[b] != second[b]} == set(touched)
    files = list((tmp_path / "t" / "data").glob("v1-*/*/*.parquet"))
    assert len(files) == len(touched)
    assert table.read().groupBy("title").count().orderBy("title").collect()[0]["count"] == 5
    assert table.read().count() == 2_000


def test_a_batch_that_is_run_again_changes_nothing(spark, table):
    table.merge(batch(spark, ("a", "a0", 1), ("b", "b0", 1)), 0)
    for _ in range(3):
        table.merge(batch(spark, ("a", "a1", 1)), 1)
        assert state(table) == [("a", "a1", 1), ("b", "b0", 0)]
    assert table.versions() == [0, 1]


def test_readers_see_whole_versions_only(spark, table, tmp_path):
    table.merge(batch(spark, ("a", "a0", 1)), 0)
    reading = table.read()
    table.merge(batch(spark, ("a", "a1", 1), ("b", "b1", 1)), 1)
    assert [r.title for r in reading.collect()] == ["a0"]  # opened before, still there
    (tmp_path / "t" / "_manifests" / "v1" / "_SUCCESS").unlink()  # as if the writer had died
    assert table.versions() == [0] and state(table) == [("a", "a0", 0)]
    table.merge(batch(spark, ("a", "a1", 1), ("b", "b1", 1)), 1)
    assert state(table) == [("a", "a1", 1), ("b", "b1", 1)]


def test_old_versions_are_deleted(spark, table, tmp_path):
    for v in range(6):
        table.merge(batch(spark, ("a", f"a{v}", 1), (f"only{v}", "x", 1)))
    assert table.versions() == [4, 5]
    assert state(table) == [("a", "a5", 5)] + [(f"only{v}", "x", v) for v in range(6)]
    named = set(table.manifest(4).values()) | set(table.manifest(5).values())
    there = {str(p.parent) for p in (tmp_path / "t" / "data").glob("*/*/*.parquet")}
    assert {Path(n.removeprefix("file:")) for n in named} == {Path(t) for t in there}


def test_rebucket(spark, table):
    table.merge(batch(spark, *[(f"u{i}", "x", i) for i in range(50)]))
    table.rebucket(3)
    assert len(table.manifest(1)) <= 3 and table.read().count() == 50
    again = KeyedTable(spark, table.path, buckets=64)  # the table's number of buckets holds
    again.merge(batch(spark, ("u7", "new", 0)))
    assert again.buckets == 3 and again.read().count() == 50
    assert again.read().where("title = 'new'").count() == 1


def test_empty_batches_and_new_columns(spark, table):
    table.merge(batch(spark).limit(0))
    assert table.read() is None
    table.merge(batch(spark, ("a", "a0", 1)))
    table.merge(batch(spark).limit(0))
    table.merge(batch(spark, ("b", "b0", 1)).withColumn("lang", F.lit("hi")))
    assert state(table) == [("a", "a0", 1), ("b", "b0", 3)]
    assert [r.lang for r in table.read().orderBy("url").collect()] == [None, "hi"]


def test_stream(spark, tmp_path):
    root = str(tmp_path)
    for landing in ([("a", "a0", 1), ("b", "b0", 2)], [("a", "a1", 1), ("c", "c1", 1)]):
        batch(spark, *landing).write.mode("append").parquet(f"{root}/landing")
        sdf = stream_table(spark, f"{root}/landing", batch(spark).schema)
        start_keyed_merge(sdf, f"{root}/table", f"{root}/checkpoint", once=True).awaitTermination()
    assert state(KeyedTable(spark, f"{root}/table")) == [("a", "a1", 1), ("b", "b0", 0), ("c", "c1", 1)]
    # the last batch is run again, as after a crash between the table and the checkpoint
    shutil.rmtree(f"{root}/checkpoint/commits")
    start_keyed_merge(sdf, f"{root}/table", f"{root}/checkpoint", once=True).awaitTermination()
    assert sorted(r.title for r in current_version(spark, f"{root}/table").collect()) == ["a1", "b0", "c1"]
