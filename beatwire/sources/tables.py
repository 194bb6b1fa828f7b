"""Reading and writing article and statistics tables, and the run log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatwire.functions.dates import parse_date
from beatwire.schemas import ARTICLE, baseline_schema
from beatwire.session import written

CSV_OPTIONS = {"header": True, "multiLine": True, "escape": '"', "mode": "PERMISSIVE"}
CORRUPT = "_corrupt_record"


def _load_or_none(reader, fmt: str, path: str) -> DataFrame | None:
    """None for a missing path; the path is checked when the plan is resolved."""
    try:
        return reader.format(fmt).load(path)
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_articles(spark: SparkSession, path: str, fmt: str = "parquet",
                  schema: T.StructType = ARTICLE) -> DataFrame | None:
    """An article table, or None when there is none yet.

    CSV files carry quoted line breaks, which keeps a file in one task; large
    corpora belong in parquet.
    """
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.options(**CSV_OPTIONS)
    return _load_or_none(reader, fmt, path)


def read_articles_checked(spark: SparkSession, path: str,
                          schema: T.StructType = ARTICLE) -> tuple[DataFrame, DataFrame]:
    """CSV articles and, beside them, the raw lines that did not parse.

    The parsed file is kept as a table, so both answers come from one reading.
    """
    wide = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    rows = (spark.read.schema(wide).options(**CSV_OPTIONS)
            .option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    rows = written(rows, "checked-csv")
    return (rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT),
            rows.where(F.col(CORRUPT).isNotNull()).select(CORRUPT))


def read_baseline(spark: SparkSession, path: str, categories: Sequence[str],
                  fmt: str = "csv") -> DataFrame | None:
    """Official statistics with a parsed date, or None when the path is missing.

    ``row_number`` is the row's place in what was read, see :func:`file_place`.
    """
    reader = spark.read.schema(baseline_schema(categories))
    if fmt == "csv":
        reader = reader.option("header", True)
    df = _load_or_none(reader, fmt, path)
    if df is None:
        return None
    return (df.select("*", file_place(fmt).alias("row_number"))
            .withColumn("date", parse_date(F.col("date"), strict=False)))


def file_place(fmt: str) -> Column:
    """Where a row stood: its file, the start of its part, its number there.

    Sorts as the files read by name, from top to bottom, however Spark splits
    them. To be selected right behind the reader. A Parquet row knows its number
    in the file; a line of text knows the start of its split and is counted from
    there.
    """
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    if fmt == "parquet":
        return F.struct(file.alias("file"), F.lit(0).cast("long").alias("start"),
                        F.col("_metadata.row_index").alias("row"))
    return F.struct(file.alias("file"), start.alias("start"), F.monotonically_increasing_id().alias("row"))


def write_articles(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                   only_if_any: bool = False) -> bool:
    """Write a table, parquet in one folder per month of ``date``.

    Rows are brought together by month in parts of even size: a month that
    holds most rows is split over many tasks, small months share one, and no
    task leaves a file in every folder. Returns False when ``only_if_any`` is
    set and there was no row to write.
    """
    if only_if_any and df.isEmpty():
        return False
    if fmt == "csv":
        df.write.mode(mode).options(header=True, escape='"').csv(path)
        return True
    month = F.date_format(parse_date(F.col("date"), strict=False), "yyyy-MM")
    (df.withColumn("month", month).hint("rebalance", "month").write.mode(mode)
     .partitionBy("month").format(fmt).save(path))
    return True


def record_run(spark: SparkSession, path: str, run_ts: str) -> None:
    """Append one line to the run log."""
    (spark.range(1).select(F.lit(run_ts).cast("timestamp").alias("run_ts"))
     .coalesce(1).write.mode("append").parquet(path))


def last_run(spark: SparkSession, path: str) -> DataFrame:
    """One row: time of the last run, ``Never`` when no run was logged."""
    log = _load_or_none(spark.read.schema("run_ts timestamp"), "parquet", path)
    if log is None:
        return spark.range(1).select(F.lit("Never").alias("last_updated"))
    newest = F.date_format(F.max("run_ts"), "yyyy-MM-dd HH:mm:ss")
    return log.agg(F.coalesce(newest, F.lit("Never")).alias("last_updated"))
