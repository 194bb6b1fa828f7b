from pyspark.sql import functions as F

from beatwire.dims import TAX11, phrase_vocab
from beatwire.operators.classify import lexicon_scorer
from beatwire.plans.refresh import start_alerts, start_refresh
from beatwire.streaming import streams as st

SCHEMA = "ord long, url string, title string, text string, ts timestamp"


def land(spark, path, rows):
    df = spark.createDataFrame(rows, "ord long, url string, title string, text string, t string")
    df.select("ord", "url", "title", "text", F.col("t").cast("timestamp").alias("ts")).coalesce(
        1).write.mode("append").parquet(path)


def test_refresh_and_alerts(spark, tmp_path):
    landing, table, alerts = (str(tmp_path / d) for d in ("landing", "table", "alerts"))
    scorer = lexicon_scorer(phrase_vocab(), hits_for_one=2)

    def run():
        sdf = st.stream_table(spark, landing, spark.createDataFrame([], SCHEMA).schema)
        start_refresh(sdf, table, f"{table}-ck", TAX11, scorer, cap=3, once=True).awaitTermination()
        start_alerts(sdf, alerts, f"{alerts}-ck", TAX11, scorer, once=True).awaitTermination()
        now = st.current_version(spark, table).collect()
        return (sorted((r.age, r.ord, r.url, r.murder, r.location) for r in now),
                sorted(r.message for r in spark.read.parquet(alerts).collect()))

    land(spark, landing, [(1, "a", "A", "a murder and homicide case in Pune", "2024-01-01 10:00:00"),
                          (2, "b", "B", "calm weather over the whole region", "2024-01-01 11:00:00"),
                          (3, "c", "C", "!!!", "2024-01-01 11:00:00")])
    first, told = run()
    assert first == [(0, 1, "a", 1, "pune"), (0, 2, "b", 0, None)]
    assert told == ["🚨 A (Murder)"]
    land(spark, landing, [(1, "a", "A again", "murder and homicide once more", "2024-01-01 12:00:00"),
                          (2, "d", "D", "quiet day, says the city council", "2024-01-01 12:00:00"),
                          (3, "e", "E", "another quiet day in the city", "2024-01-01 12:00:00")])
    second, told = run()
    # three rows: the new ones; the newest row of "a" replaced the old one
    assert second == [(0, 1, "a", 1, None), (0, 2, "d", 0, None), (0, 3, "e", 0, None)]
    assert told == ["🚨 A (Murder)"]                       # not repeated for the same address
    assert run() == (second, told)                          # nothing new landed


def test_late_data_is_dropped(spark, tmp_path):
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        sdf = st.stream_table(spark, landing, spark.createDataFrame([], SCHEMA).schema)
        counts = st.stream_trend(sdf, "title").select(
            F.date_format("window.start", "yyyy-MM-dd").alias("day"), "title", "n")
        st.start_updates(counts, out, f"{out}-ck", once=True).awaitTermination()
        got = st.latest_updates(spark, out, ["day", "title"], "n").collect()
        return sorted((r.day, r.title, r.n) for r in got)

    land(spark, landing, [(1, "u", "x", "", "2024-01-01 10:00:00"), (2, "u", "x", "", "2024-01-03 09:00:00")])
    assert run() == [("2024-01-01", "x", 1), ("2024-01-03", "x", 1)]
    land(spark, landing, [(3, "u", "x", "", "2024-01-01 23:00:00"), (4, "u", "x", "", "2024-01-03 08:30:00")])
    assert run() == [("2024-01-01", "x", 1), ("2024-01-03", "x", 2)]


def test_newest_of_a_key_is_told_as_it_comes(spark, tmp_path):
    root, schema = str(tmp_path), "url string, title string, text string, ts timestamp"

    def land(*rows):
        df = spark.createDataFrame([(u, t, "", None if d is None else f"2024-01-{d:02d}") for u, t, d in rows],
                                   "url string, title string, text string, d string")
        df = df.select("url", "title", "text", F.col("d").cast("timestamp").alias("ts"))
        df.write.mode("append").parquet(f"{root}/landing")
        sdf = st.stream_table(spark, f"{root}/landing", df.schema)
        st.start_newest(sdf, f"{root}/out", f"{root}/checkpoint", delay="10 days", once=True).awaitTermination()

    def told(kind):
        rows = spark.read.schema(f"{schema}, update long, batch_id long").parquet(f"{root}/out/{kind}").collect()
        return sorted((r.batch_id, r.url or "", r.title, r.update) for r in rows)

    land(("a", "a1", 5), ("a", "a2", 7), ("b", "b1", 20), (None, "n", 6), ("d", "d1", 4))
    assert told("updates") == [(0, "", "n", 1), (0, "a", "a2", 1), (0, "b", "b1", 1), (0, "d", "d1", 1)]
    # the watermark is the 10th: a and d have ended, b is replaced, an older b is no news
    land(("a", "a3", 12), ("b", "b2", 21), ("b", "b0", 19), ("c", "late", 9), (None, "no time", None))
    assert told("updates")[4:] == [(1, "a", "a3", 1), (1, "b", "b2", 2)]
    assert told("late") == [(1, "", "no time", None), (1, "c", "late", None)]
    land(("b", "b again", 21), ("a", "a4", 13), ("e", "e1", 31))
    assert told("updates")[6:] == [(2, "a", "a4", 2), (2, "e", "e1", 1)]
    land(("a", "a5", 30), ("b", "b3", 20))  # the watermark is the 21st
    assert told("updates")[8:] == [(3, "a", "a5", 1)] and told("late")[2:] == [(3, "b", "b3", None)]
