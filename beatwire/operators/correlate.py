"""A predicted trend against official statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from beatwire.functions.stats import pearson, pearson_p
from beatwire.operators.trend import fill_gaps
from beatwire.session import written


# Place of a row in the file it was read from.
ROW_NUMBER = "row_number"


def monthly(baseline: DataFrame, categories: Sequence[str], date_col: str = "date") -> DataFrame:
    """Statistics summed by month, empty months included."""
    sums = (baseline.select(F.last_day(date_col).alias("month_end"), *categories)
            .where(F.col("month_end").isNotNull())
            .groupBy("month_end").agg(*[F.sum(c).alias(c) for c in categories]))
    return fill_gaps(sums, "month_end", categories, "month")


def _bound(df: DataFrame, fn, col: str = "month_end") -> Column:
    return df.agg(fn(col).alias("b")).scalar()


def _shared(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns and c not in ("month_end", "pos", "date", ROW_NUMBER)]


def _numbered(df: DataFrame, order: str) -> DataFrame:
    """Positions from 1. The input has one row per month at most, or as many rows as months."""
    return df.withColumn("pos", F.row_number().over(W.orderBy(order)))


def _paired(left: DataFrame, right: DataFrame, on: str, cats: Sequence[str]) -> DataFrame:
    """Rows (on, category, predicted, official) of two wide series."""
    a = left.select(on, *cats).unpivot([on], list(cats), "category", "predicted")
    b = right.select(on, *cats).unpivot([on], list(cats), "category", "official")
    return (a.withColumn("predicted", F.col("predicted").cast("double"))
            .join(b.withColumn("official", F.col("official").cast("double")),
                  [on, "category"]))


def align_months(trend: DataFrame, baseline: DataFrame, mode: str = "by_month",
                 date_col: str = "date", position: str | None = None) -> DataFrame:
    """Pairs of predicted and official values, one row per category and place.

    ``by_month`` pairs equal months. ``positional`` repeats the pairing by
    place: statistics are cut to the months both sides cover, then both series
    are read from their first row until the shorter ends. When the two share
    no month the first raw, unsummed statistics rows are used instead, as many
    as there are predicted months, in the order of ``position`` (the row number
    of the file; the date where there is none). Categories absent on a side
    give no row.

    Positional pairing keeps both monthly series, a row a month, as tables and
    reads their bounds from there.
    """
    cats = _shared(trend, baseline)
    months = monthly(baseline, cats, date_col)
    if mode == "by_month":
        return _paired(trend, months, "month_end", cats)
    if mode != "positional":
        raise ValueError(f"unknown mode {mode!r}")
    trend, months = written(trend, "trend"), written(months, "months")
    bounds = [F.min("month_end").alias("first"), F.max("month_end").alias("last"),
              F.count("*").alias("n")]
    t, m = trend.agg(*bounds).first(), months.agg(*bounds).first()
    if t.n and m.n and max(t.first, m.first) <= min(t.last, m.last):
        official = _numbered(months.where(F.col("month_end").between(
            max(t.first, m.first), min(t.last, m.last))), "month_end")
    else:
        place = position or date_col
        official = _numbered(baseline.orderBy(place).limit(t.n).select(
            F.col(place).alias("place"), *cats), "place")
    return _paired(_numbered(trend, "month_end"), official, "pos", cats)


def correlate(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Pearson r, its p-value and significance per category; nulls when undefined."""
    return (pairs.groupBy("category")
            .agg(F.count(F.lit(1)).alias("n"),
                 pearson(F.col("predicted"), F.col("official")).alias("r"))
            .withColumn("p_value", pearson_p(F.col("r"), F.col("n")))
            .withColumn("significant", F.coalesce(F.col("p_value") < alpha, F.lit(False))))


def month_coverage(trend: DataFrame, baseline: DataFrame, date_col: str = "date") -> DataFrame:
    """Months on each side and the range both cover. One row."""
    months = monthly(baseline, _shared(trend, baseline), date_col)
    start = F.greatest(_bound(trend, F.min), _bound(months, F.min))
    end = F.least(_bound(trend, F.max), _bound(months, F.max))
    one = trend.sparkSession.range(1).select(
        trend.agg(F.count(F.lit(1)).alias("n")).scalar().alias("predicted_months"),
        months.agg(F.count(F.lit(1)).alias("n")).scalar().alias("official_months"),
        start.alias("_start"), end.alias("_end"))
    overlap = F.col("_start") <= F.col("_end")
    return one.select(
        "predicted_months", "official_months",
        F.when(overlap, F.col("_start")).alias("overlap_start"),
        F.when(overlap, F.col("_end")).alias("overlap_end"),
        F.when(overlap, F.months_between("_end", "_start").cast("bigint") + 1)
        .otherwise(F.lit(0)).alias("overlap_months"))
