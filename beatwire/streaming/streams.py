"""Continuous ingest, de-duplication, merge, alerts and trend.

The batch operators are reused unchanged wherever they hold no state. State
is bounded by a watermark; the table of record is kept by ``start_merge``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from beatwire.dims import CRITICAL
from beatwire.operators.merge import first_per, merge_batch
from beatwire.operators.select import with_alert
from beatwire.session import remove, written
from beatwire.sources.tables import _load_or_none
from beatwire.streaming.keyed_table import BUCKETS, KeyedTable

CADENCE = "5 minutes"
COMMIT_SCHEMA = "batch_id long, path string"
KEPT_VERSIONS = 2


def stream_table(spark: SparkSession, path: str, schema: T.StructType,
                 fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Files landing under a path (a folder, or a pattern of files or folders)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def stream_dedupe(sdf: DataFrame, key: str = "url", event_time: str = "ts",
                  delay: str = "1 day", stand_in: Sequence[str] = ("title", "text")) -> DataFrame:
    """The first arrival per key within ``delay``; older keys leave the state.

    Rows without a key are told apart by a digest of the columns ``stand_in``.
    For alerts and append-only sinks. The table of record keeps the newest
    row of a key instead, see :func:`start_merge`.
    """
    return (sdf.withColumn("_identity", _identity(key, stand_in)).withWatermark(event_time, delay)
            .dropDuplicatesWithinWatermark(["_identity"]).drop("_identity"))


def _identity(key: str, stand_in: Sequence[str]) -> Column:
    """What tells rows apart: the key, or a digest of other columns where there is none."""
    digest = F.sha2(F.to_json(F.struct(*stand_in)), 256)
    return F.when(F.col(key).isNull(), F.concat(F.lit("#"), digest)).otherwise(
        F.concat(F.lit("="), F.col(key)))


def stream_alerts(sdf: DataFrame, keys: Sequence[str] = CRITICAL) -> DataFrame:
    """Alerts as they arrive; stateless, so nothing is capped or repeated."""
    return with_alert(sdf, keys)


def stream_trend(sdf: DataFrame, category: str, event_time: str = "ts",
                 window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts per window and category; events behind the watermark are dropped."""
    return (sdf.withWatermark(event_time, delay)
            .groupBy(F.window(event_time, window), category)
            .agg(F.count(F.lit(1)).alias("n")))


def _trigger(writer: DataStreamWriter, once: bool) -> DataStreamWriter:
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=CADENCE)


def start_append(sdf: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append the rows of a stream to a parquet table, exactly once."""
    writer = (sdf.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint))
    return _trigger(writer, once).start(path)


def start_updates(sdf: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write changed aggregate rows, one folder per batch, replaced if a batch is retried."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = sdf.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return _trigger(writer.foreachBatch(save), once).start()


def latest_updates(spark: SparkSession, path: str, keys: Sequence[str], value: str) -> DataFrame:
    """The last written value of every key of :func:`start_updates`."""
    return spark.read.parquet(path).groupBy(*keys).agg(F.max_by(value, "batch_id").alias(value))


def current_version(spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
    """The last committed version of a merged table, or None."""
    keyed = KeyedTable(spark, table)
    if before is None and keyed.versions():
        return keyed.read()
    log = _load_or_none(spark.read.schema(COMMIT_SCHEMA), "parquet", f"{table}/_log")
    if log is None:
        return None
    if before is not None:
        log = log.where(F.col("batch_id") < before)
    newest = log.agg(F.max(F.struct("batch_id", "path")).alias("c")).select("c.path").first()
    return spark.read.parquet(newest.path) if newest and newest.path else None


def start_newest(sdf: DataFrame, path: str, checkpoint: str, key: str = "url",
                 event_time: str = "ts", delay: str = "1 day",
                 stand_in: Sequence[str] = ("title", "text"), once: bool = False) -> StreamingQuery:
    """Emit a row whenever it is the newest of its key so far.

    The state is a :class:`KeyedTable` of one small row a key: the time of the
    newest row and how often it was replaced. Of a batch, the newest row of a key
    counts (the other columns decide ties); if it is newer than the state it goes
    to ``updates`` with its number. The watermark is the latest time of all batches
    before, less ``delay``: a row behind it, or without a time, goes to ``late``,
    and a key's state that falls behind it ends. Every batch writes folders of its
    own number, so one that is run again replaces what it wrote.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = KeyedTable(spark, f"{path}/state", "_identity", ())
        marks = _load_or_none(spark.read.schema("latest timestamp, batch_id long"), "parquet",
                              f"{path}/_latest")
        latest = F.lit(None).cast("timestamp")
        if marks is not None:
            earlier = marks.where(F.col("batch_id") < batch_id).agg(F.max("latest")).first()[0]
            latest = F.lit(earlier).cast("timestamp")
        mark = latest - F.expr(f"interval {delay}")
        rows = written(batch.withColumn("_identity", _identity(key, stand_in))
                       .withColumn("_mark", mark), "arrived")
        behind = F.col(event_time).isNull() | F.coalesce(F.col(event_time) < F.col("_mark"), F.lit(False))
        rows.where(behind).select(*batch.columns).write.mode("overwrite").parquet(
            f"{path}/late/batch_id={batch_id}")
        place = [F.desc(event_time), *[F.asc(c) for c in sorted(batch.columns) if c != event_time]]
        fresh = written(first_per(rows.where(~behind), ["_identity"], place), "newest")
        old = state.near(fresh, batch_id)
        if old is None:
            news = fresh.withColumn("update", F.lit(1).cast("long"))
        else:
            alive = old.where(F.coalesce(F.col("at") >= mark, F.lit(True))).select(
                "_identity", "at", F.col("update").alias("_before"))
            news = (fresh.join(alive, "_identity", "left")
                    .where(F.col("at").isNull() | (F.col(event_time) > F.col("at")))
                    .withColumn("update", F.coalesce("_before", F.lit(0)).cast("long") + 1))
        news = written(news.select("_identity", *batch.columns, "update"), "updates")
        news.drop("_identity").write.mode("overwrite").parquet(f"{path}/updates/batch_id={batch_id}")
        state.merge(news.select("_identity", F.col(event_time).alias("at"), "update"), batch_id,
                    keep=F.coalesce(F.col("at") >= mark, F.lit(True)))
        (rows.agg(F.greatest(F.max(event_time), latest).alias("latest")).write.mode("overwrite")
         .parquet(f"{path}/_latest/batch_id={batch_id}"))
        remove(spark, f"{path}/_latest/batch_id={batch_id - KEPT_VERSIONS}")

    writer = sdf.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
    return _trigger(writer, once).start()


def start_keyed_merge(sdf: DataFrame, table: str, checkpoint: str, key: str = "url",
                      order: Sequence[str] = ("ord",), buckets: int = BUCKETS,
                      prepare: Callable[[DataFrame], DataFrame] | None = None,
                      once: bool = False) -> StreamingQuery:
    """Merge every batch into a table of one row per key, newest batch first, without a cap."""
    def save(batch: DataFrame, batch_id: int) -> None:
        target = KeyedTable(batch.sparkSession, table, key, order, buckets)
        target.merge(prepare(batch) if prepare else batch, batch_id)

    writer = sdf.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
    return _trigger(writer, once).start()


def start_merge(sdf: DataFrame, table: str, checkpoint: str, key: str = "url",
                order: Sequence[str] = ("ord",), cap: int | None = 500,
                prepare: Callable[[DataFrame], DataFrame] | None = None,
                once: bool = False) -> StreamingQuery:
    """Merge every batch into a table, newest row of a key first, capped.

    A batch writes a new version of the table and then logs it; readers see
    the last logged version. A batch that is run again starts from the version
    before it and replaces its own, so the outcome is the same; the last two
    versions are kept. ``age`` counts the batches since a row arrived; with
    ``order`` it is the order of the cap.

    Without a cap the table grows, and a batch writes only the buckets that its
    keys fall into, see :class:`KeyedTable`; ``arrived`` takes the place of ``age``.
    """
    if cap is None:
        return start_keyed_merge(sdf, table, checkpoint, key, order, prepare=prepare, once=once)

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = (prepare(batch) if prepare else batch).withColumn("age", F.lit(0))
        old = current_version(spark, table, before=batch_id)
        if old is not None:
            old = old.withColumn("age", F.col("age") + 1)
        version = f"{table}/v{batch_id}"
        (merge_batch(new, old, key, ("age", *order), cap).drop("batch_rank")
         .write.mode("overwrite").parquet(version))
        (spark.createDataFrame([(batch_id, version)], COMMIT_SCHEMA).coalesce(1)
         .write.mode("append").parquet(f"{table}/_log"))
        remove(spark, f"{table}/v{batch_id - KEPT_VERSIONS}")

    writer = sdf.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
    return _trigger(writer, once).start()
