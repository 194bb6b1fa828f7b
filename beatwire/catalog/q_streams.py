"""Streaming queries, run over what has landed and read back from their sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatwire.catalog.q_articles import ALERT_SQL, CRITICAL_SQL
from beatwire.catalog.q_merge import BATCHES_SQL, PLACE_SQL, batches
from beatwire.catalog.registry import query, table
from beatwire.catalog.views import (
    ARTICLES_SQL, LABELLED_SQL, PHRASES, articles, as_articles, as_labelled,
)
from beatwire.dims import TAX11
from beatwire.operators.classify import lexicon_scorer
from beatwire.plans.refresh import start_alerts
from beatwire.session import work_dir
from beatwire.streaming import streams as st


def _landed(spark, sf_dir, name):
    """A table as a stream; the pattern fits a file as well as a folder of files."""
    return st.stream_table(spark, f"{sf_dir}/{name}.parquet*", table(spark, sf_dir, name).schema)


def _appended(spark, sdf, purpose):
    """Run a stream over everything landed and read what it appended."""
    root = work_dir(spark, purpose)
    st.start_append(sdf, f"{root}/rows", f"{root}/checkpoint", once=True).awaitTermination()
    return spark.read.schema(sdf.schema).parquet(f"{root}/rows")


def _timed(df):
    return df.withColumn("ts", F.to_timestamp("date"))


@query("stream_ingest", f"WITH {ARTICLES_SQL} SELECT doc_id, title, date, url, source FROM articles")
def stream_ingest(spark, sf_dir):
    sdf = as_articles(_landed(spark, sf_dir, "documents"))
    return _appended(spark, sdf.select("doc_id", "title", "date", "url", "source"), "ingest")


@query("stream_dedupe", f"""WITH {ARTICLES_SQL} SELECT url, NULL AS title FROM articles
WHERE url IS NOT NULL GROUP BY url UNION ALL SELECT NULL, title FROM
(SELECT DISTINCT title, text FROM articles WHERE url IS NULL)""")
def stream_dedupe(spark, sf_dir):
    """One arrival per address; without an address, per title and text."""
    sdf = _timed(as_articles(_landed(spark, sf_dir, "documents")).select(
        "url", "title", "text", "date"))
    return _appended(spark, st.stream_dedupe(sdf), "dedupe").select(
        "url", F.when(F.col("url").isNull(), F.col("title")).alias("title"))


@query("stream_alerts", f"WITH {LABELLED_SQL} SELECT doc_id, {ALERT_SQL} AS message FROM labelled "
       f"WHERE {CRITICAL_SQL}")
def stream_alerts(spark, sf_dir):
    sdf = as_labelled(as_articles(_landed(spark, sf_dir, "documents")))
    return _appended(spark, st.stream_alerts(sdf).select("doc_id", "message"), "alerts")


@query("stream_trend", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n "
       "FROM events GROUP BY 1, 2")
def stream_trend(spark, sf_dir):
    sdf = _landed(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), "event_type")
    root = work_dir(spark, "trend")
    counts = st.stream_trend(sdf, "event_type").select(
        F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")
    st.start_updates(counts, f"{root}/rows", f"{root}/checkpoint", once=True).awaitTermination()
    return st.latest_updates(spark, f"{root}/rows", ["day", "event_type"], "n")


@query("stream_merge", f"WITH {BATCHES_SQL} SELECT doc_id, title, date, url, source "
       f"FROM merged ORDER BY {PLACE_SQL} LIMIT 500")
def stream_merge(spark, sf_dir):
    """The old batch lands and is merged, then the new one; the table as it then stands."""
    root = work_dir(spark, "merge")
    new, old = batches(spark, sf_dir)
    for batch in (old, new):
        batch.write.mode("append").parquet(f"{root}/landing")
        sdf = st.stream_table(spark, f"{root}/landing", batch.schema)
        st.start_merge(sdf, f"{root}/table", f"{root}/checkpoint", once=True).awaitTermination()
    return st.current_version(spark, f"{root}/table").select(
        "doc_id", "title", "date", "url", "source")


@query("stream_merge_all", f"WITH {BATCHES_SQL} SELECT doc_id, title, date, url, source, "
       "1 - batch_rank AS arrived FROM merged")
def stream_merge_all(spark, sf_dir):
    """The same without a cap: the second batch writes the buckets of its keys alone."""
    root = work_dir(spark, "merge-all")
    new, old = batches(spark, sf_dir)
    for batch in (old, new):
        batch.write.mode("append").parquet(f"{root}/landing")
        sdf = st.stream_table(spark, f"{root}/landing", batch.schema)
        st.start_merge(sdf, f"{root}/table", f"{root}/checkpoint", cap=None,
                       once=True).awaitTermination()
    return st.current_version(spark, f"{root}/table").select(
        "doc_id", "title", "date", "url", "source", F.col("arrived").cast("int").alias("arrived"))


NEWEST_DELAY = 365  # days


@query("stream_newest", f"""WITH {ARTICLES_SQL},
rowsx AS (SELECT doc_id, date, CAST(date AS DATE) AS ts, coalesce('=' || url, '#' || title || chr(1) || text) AS id,
  doc_id % 2 AS batch FROM articles),
mark AS (SELECT max(ts) - INTERVAL {NEWEST_DELAY} DAY AS m FROM rowsx WHERE batch = 0),
fresh AS (SELECT * FROM rowsx, mark WHERE batch = 0 OR ts >= m),
newest AS (SELECT *, row_number() OVER (PARTITION BY batch, id ORDER BY ts DESC, doc_id) AS rn FROM fresh),
state AS (SELECT id, ts FROM newest WHERE batch = 0 AND rn = 1)
SELECT batch, 'update' AS kind, doc_id, 1 AS number FROM newest WHERE batch = 0 AND rn = 1
UNION ALL SELECT 1, 'update', n.doc_id, CASE WHEN s.ts >= n.m THEN 2 ELSE 1 END
  FROM newest n LEFT JOIN state s USING (id) WHERE batch = 1 AND rn = 1 AND (s.ts IS NULL OR s.ts < n.m OR n.ts > s.ts)
UNION ALL SELECT 1, 'late', doc_id, 0 FROM rowsx, mark WHERE batch = 1 AND ts < m""")
def stream_newest(spark, sf_dir):
    """Two landings with repeats across them: updates with their number, and late rows aside."""
    root = work_dir(spark, "newest")
    df = _timed(articles(spark, sf_dir).select("doc_id", "title", "text", "url", "date"))
    late = F.col("doc_id") % 2 == 1
    for batch in (df.where(~late), df.where(late)):
        batch.write.mode("append").parquet(f"{root}/landing")
        sdf = st.stream_table(spark, f"{root}/landing", batch.schema)
        st.start_newest(sdf, f"{root}/out", f"{root}/checkpoint", delay=f"{NEWEST_DELAY} days",
                        once=True).awaitTermination()

    def told(kind, number):
        return spark.read.parquet(f"{root}/out/{kind}").select(
            F.col("batch_id").cast("int").alias("batch"), F.lit(kind.removesuffix("s")).alias("kind"),
            "doc_id", number.cast("int").alias("number"))

    return told("updates", F.col("update")).unionByName(told("late", F.lit(0)))


@query("refresh_alerts", f"WITH {LABELLED_SQL} SELECT DISTINCT url, "
       f"CASE WHEN url IS NULL THEN {ALERT_SQL} END AS message FROM labelled WHERE {CRITICAL_SQL}")
def refresh_alerts(spark, sf_dir):
    """Alerts of two landings, classified from the text; none without an address is lost."""
    root = work_dir(spark, "refresh-alerts")
    df = articles(spark, sf_dir).select("doc_id", "title", "text", "url", "date").withColumn(
        "ts", F.to_timestamp("date"))
    late = F.col("doc_id") % 2 == 1
    for batch in (df.where(~late), df.where(late)):
        batch.write.mode("append").parquet(f"{root}/landing")
        sdf = st.stream_table(spark, f"{root}/landing", batch.schema)
        start_alerts(sdf, f"{root}/rows", f"{root}/checkpoint", TAX11,
                     lexicon_scorer(PHRASES, hits_for_one=2), delay="1000 days",
                     once=True).awaitTermination()
    return spark.read.parquet(f"{root}/rows").select(
        "url", F.when(F.col("url").isNull(), F.col("message")).alias("message")).distinct()
