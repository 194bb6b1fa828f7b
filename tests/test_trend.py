import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from beatwire.dims import TAX6
from beatwire.functions.stats import pearson_p
from beatwire.operators.correlate import align_months, correlate, month_coverage
from beatwire.operators.trend import category_totals, overview, trend
from beatwire.plans.batch import trend_and_correlation
from beatwire.sources.synthetic import mock_baseline

D = dt.date


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_months_without_rows_are_zero(spark):
    df = spark.createDataFrame([("2024-02-29", 1), ("2024-02-01", 1), ("2024-05-31", 1)],
                               "date string, theft int")
    assert rows(trend(df, ["theft"]), "month_end", "theft") == [
        (D(2024, 2, 29), 2), (D(2024, 3, 31), 0), (D(2024, 4, 30), 0), (D(2024, 5, 31), 1)]


def test_weeks_end_on_sunday(spark):
    df = spark.createDataFrame([("2024-01-07", 1), ("2024-01-08", 1), ("2024-01-28", 1)],
                               "date string, a int")
    assert rows(trend(df, ["a"], grain="week"), "week_end", "a") == [
        (D(2024, 1, 7), 1), (D(2024, 1, 14), 1), (D(2024, 1, 21), 0), (D(2024, 1, 28), 1)]


def test_bad_dates(spark):
    df = spark.createDataFrame([("2024-01-07", 1), ("n/a", 5), (None, 7)], "date string, a int")
    assert rows(trend(df, ["a"], strict=False), "month_end", "a") == [(D(2024, 1, 31), 1)]
    with pytest.raises(Exception):
        trend(df, ["a"]).collect()


def test_totals_agree_with_trend(spark):
    df = spark.range(300).select(
        F.date_format(F.date_add(F.lit("2024-01-01"), (F.col("id") * 3).cast("int")),
                      "yyyy-MM-dd").alias("date"),
        (F.col("id") % 4).cast("string").alias("source"),
        *[F.when(F.col("id") % (n + 2) == 0, 1).otherwise(0).alias(c)
          for n, c in enumerate(TAX6)])
    monthly = trend(df, TAX6).agg(*[F.sum(c).alias(c) for c in TAX6]).first().asDict()
    totals = category_totals(df, TAX6).collect()
    assert {r.category: r.total for r in totals} == monthly
    assert [r.total for r in totals] == sorted(monthly.values(), reverse=True)
    one = overview(df, TAX6).first()
    assert (one.n_articles, one.n_sources, one.n_labels) == (300, 4, sum(monthly.values()))
    assert overview(df, TAX6, approximate=True).first().n_sources == 4


def series(spark, start, values, name="month_end"):
    y, m = start
    out = []
    for v in values:
        out.append((D(y + m // 12, m % 12 + 1, 1) - dt.timedelta(days=1), *v))
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
    cols = ", ".join(f"c{i} double" for i in range(len(values[0])))
    return spark.createDataFrame(out, f"{name} date, {cols}")


def test_alignment(spark):
    pred = series(spark, (2024, 1), [(1.0,), (2.0,), (3.0,), (4.0,)])
    base = series(spark, (2024, 3), [(30.0,), (40.0,), (50.0,)], "date")
    assert rows(align_months(pred, base), "month_end", "predicted", "official") == [
        (D(2024, 3, 31), 3.0, 30.0), (D(2024, 4, 30), 4.0, 40.0)]
    # by place the first predicted month meets the first common one
    assert rows(align_months(pred, base, "positional"), "pos", "predicted", "official") == [
        (1, 1.0, 30.0), (2, 2.0, 40.0)]
    c = month_coverage(pred, base).first()
    assert (c.predicted_months, c.official_months, c.overlap_months) == (4, 3, 2)
    assert (c.overlap_start, c.overlap_end) == (D(2024, 3, 31), D(2024, 4, 30))


def test_no_common_month(spark):
    pred = series(spark, (2024, 1), [(1.0,), (2.0,)])
    base = spark.createDataFrame([(D(2020, 1, d), float(d)) for d in range(1, 6)],
                                 "date date, c0 double")
    assert align_months(pred, base).count() == 0
    assert rows(align_months(pred, base, "positional"), "pos", "predicted", "official") == [
        (1, 1.0, 1.0), (2, 2.0, 2.0)]                      # raw rows, not month sums
    c = month_coverage(pred, base).first()
    assert (c.overlap_start, c.overlap_months) == (None, 0)


def test_correlation(spark):
    pred = series(spark, (2024, 1), [(1.0, 5.0, 1.0), (2.0, 5.0, 2.0), (4.0, 5.0, 1.5), (3.0, 5.0, 9.0)])
    base = series(spark, (2024, 1), [(2.0, 1.0), (4.0, 2.0), (8.0, 3.0), (6.0, 4.0)], "date")
    got = {r.category: r for r in correlate(align_months(pred, base)).collect()}
    assert set(got) == {"c0", "c1"}                          # c2 is missing on one side
    assert abs(got["c0"].r - 1) < 1e-12 and got["c0"].p_value < 1e-6 and got["c0"].significant
    assert got["c1"].r is None and got["c1"].p_value is None and not got["c1"].significant


def test_few_months(spark):
    one = correlate(align_months(series(spark, (2024, 1), [(1.0,)]),
                                 series(spark, (2024, 1), [(2.0,)], "date"))).first()
    assert (one.r, one.p_value) == (None, None)
    two = correlate(align_months(series(spark, (2024, 1), [(1.0,), (2.0,)]),
                                 series(spark, (2024, 1), [(5.0,), (4.0,)], "date"))).first()
    assert (two.r, two.p_value) == (-1.0, 1.0)


def test_p_value_table(spark):
    """Published two-sided 5 percent points of Student's t."""
    points = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 10: 2.228, 30: 2.042, 120: 1.980}
    data = [(v + 2, t / math.sqrt(v + t * t)) for v, t in points.items()]
    df = spark.createDataFrame(data, "n long, r double")
    for r in df.select("n", pearson_p(F.col("r"), F.col("n")).alias("p")).collect():
        assert abs(r.p - 0.05) < 2e-4, r
    edge = spark.createDataFrame([(5, 1.0), (5, -1.0), (5, 0.0), (1, 0.5), (4, None)],
                                 "n long, r double")
    got = [r[0] for r in edge.select(pearson_p(F.col("r"), F.col("n"))).collect()]
    assert got[0] < 1e-9 and got[1] < 1e-9 and abs(got[2] - 1) < 1e-12
    assert got[3] is None and got[4] is None


def test_plan_with_and_without_statistics(spark):
    df = spark.range(200).select(
        F.date_format(F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")),
                      "yyyy-MM-dd").alias("date"),
        (F.col("id") % 3 == 0).cast("int").alias("theft"))
    monthly, corr = trend_and_correlation(df, ["theft"])
    assert monthly.count() == 7 and corr.collect() == []  # nothing is made up
    official = mock_baseline(monthly, ["theft"]).withColumnRenamed("month_end", "date")
    assert trend_and_correlation(df, ["theft"], official)[1].first().n == 7


def test_tables_without_flags_or_sources(spark):
    df = spark.createDataFrame([(1, "a"), (0, "b")], "theft int, source string")
    assert category_totals(df, ["theft", "murder"]).collect() == []
    assert [tuple(r) for r in category_totals(df, ["theft"]).collect()] == [("theft", 1)]
    assert tuple(overview(df, ["theft", "murder"]).first()) == (2, 2, None)
    assert tuple(overview(df.drop("source"), ["theft"]).first()) == (2, None, 1)
    assert tuple(overview(df.drop("source"), ["rape"], approximate=True).first()) == (2, None, None)
