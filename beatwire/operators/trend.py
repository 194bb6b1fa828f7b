"""Counts over time and over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from beatwire.functions.dates import month_end, parse_date, week_end

GRAINS = {"month": month_end, "week": week_end}


def fill_gaps(series: DataFrame, col: str, values: Sequence[str], grain: str) -> DataFrame:
    """Add the periods missing between two present ones, with zeros.

    ``series`` has one row per period, so the unpartitioned window runs over
    at most one row per month or week of the calendar, whatever the size of
    the data behind it. Months are counted from their first day, because a
    sequence that starts on 29 February never reaches 31 March.
    """
    following = F.lead(col).over(W.orderBy(col))
    if grain == "month":
        starts = F.sequence(F.trunc(col, "month"), F.trunc("_next", "month"),
                            F.expr("interval 1 month"))
        periods = F.transform(starts, lambda d: F.last_day(d))
    else:
        periods = F.sequence(F.col(col), F.col("_next"), F.expr("interval 7 days"))
    # The next present period is its own row, so drop it from this one's list.
    own = F.when(F.col("_next").isNull(), F.array(F.col(col))).otherwise(
        F.slice(periods, F.lit(1), F.size(periods) - 1))
    spread = series.withColumn("_next", following).select(
        *series.columns, F.explode(own).alias("_period"))
    return spread.select(
        F.col("_period").alias(col),
        *[F.when(F.col("_period") == F.col(col), F.col(v)).otherwise(F.lit(0)).alias(v)
          for v in values])


def trend(df: DataFrame, categories: Sequence[str], date_col: str = "date",
          grain: str = "month", strict: bool = True) -> DataFrame:
    """Sum of every flag per month or week, empty periods included.

    Periods are named by their last day. With ``strict`` an unreadable date
    fails the job, else the row is left out.
    """
    label = f"{grain}_end"
    day = parse_date(F.col(date_col), strict)
    sums = (df.select(GRAINS[grain](day).alias(label), *categories)
            .where(F.col(label).isNotNull())
            .groupBy(label)
            .agg(*[F.sum(c).cast("bigint").alias(c) for c in categories]))
    return fill_gaps(sums, label, categories, grain)


def category_totals(df: DataFrame, categories: Sequence[str]) -> DataFrame:
    """One row per category with its total, largest first; none if a flag is not there."""
    if not set(categories) <= set(df.columns):
        return df.sparkSession.createDataFrame([], "category string, total bigint")
    totals = df.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
                      for c in categories])
    return (totals.unpivot([], list(categories), "category", "total")
            .orderBy(F.desc("total"), F.asc("category")))


def overview(df: DataFrame, categories: Sequence[str], approximate: bool = False) -> DataFrame:
    """Articles, distinct sources, labels set. One row.

    Null stands for sources of a table without that column, and for labels of
    one that lacks a flag.
    """
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    unknown = F.lit(None).cast("bigint")
    labels = unknown
    if set(categories) <= set(df.columns):
        labels = F.lit(0)
        for c in categories:
            labels = labels + F.coalesce(F.col(c), F.lit(0))
        labels = F.coalesce(F.sum(labels), F.lit(0)).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("n_articles"),
                  (distinct("source") if "source" in df.columns else F.max(unknown)).alias("n_sources"),
                  (labels if labels is not unknown else F.max(unknown)).alias("n_labels"))


def language_counts(df: DataFrame, col: str = "lang") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def source_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
