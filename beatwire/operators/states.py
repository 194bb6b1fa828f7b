"""Counts, distinct sketches and co-moments of each day, kept so that they can be merged.

A batch of rows becomes one state row for each day and group and is appended to
what was there; a day may have many such rows. Any range of days is then answered
from the states alone, without reading a row again: counts and sums add up,
sketches are united, and co-moments are merged by the means of their parts, which
loses no precision to large values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Buckets of a sketch are 2**LG_K; the relative standard error is about 1.04 / sqrt(2**LG_K),
# or 0.8 %. Some hundred distinct values are counted exactly.
LG_K = 14


def overview_states(df: DataFrame, day: str, categories: Sequence[str], source: str = "source") -> DataFrame:
    """(day, n_articles, n_labels, sources): one row a day, ``sources`` being a sketch."""
    labels = F.lit(0)
    for c in categories:
        labels = labels + F.coalesce(F.col(c), F.lit(0))
    return df.groupBy(F.col(day).alias("day")).agg(
        F.count(F.lit(1)).alias("n_articles"), F.sum(labels).cast("bigint").alias("n_labels"),
        F.hll_sketch_agg(source, F.lit(LG_K)).alias("sources"))


def _between(states: DataFrame, first: str | None, last: str | None) -> DataFrame:
    if first is not None:
        states = states.where(F.col("day") >= F.lit(first))
    return states if last is None else states.where(F.col("day") <= F.lit(last))


def overview_of(states: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Articles, distinct sources (about) and labels from ``first`` to ``last``. One row."""
    united = F.hll_sketch_estimate(F.hll_union_agg("sources"))
    return _between(states, first, last).agg(
        F.coalesce(F.sum("n_articles"), F.lit(0)).alias("n_articles"),
        F.coalesce(united, F.lit(0)).alias("n_sources"),
        F.coalesce(F.sum("n_labels"), F.lit(0)).alias("n_labels"))


def moment_states(df: DataFrame, day: str, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(day, *keys, n, mean_x, mean_y, m2_x, m2_y, c_xy) of the rows that have both numbers."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(day).alias("day"), *keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    n = F.count(F.lit(1))
    return both.groupBy("day", *keys).agg(
        n.alias("n"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"),
        (F.var_pop("x") * n).alias("m2_x"), (F.var_pop("y") * n).alias("m2_y"),
        (F.covar_pop("x", "y") * n).alias("c_xy"))


def merge_moments(states: DataFrame, keys: Sequence[str], first: str | None = None,
                  last: str | None = None) -> DataFrame:
    """The moments of a range of days, in the columns of a state without its day.

    A part contributes its own spread and that of its means around the whole's.
    """
    parts = _between(states, first, last).select(
        *[F.col(k).alias(f"_{k}") for k in keys], *[c for c in states.columns if c not in (*keys, "day")])

    def mean(c: str) -> Column:
        return F.sum(F.col("n") * F.col(c)) / F.sum("n")

    whole = parts.groupBy(*[f"_{k}" for k in keys]).agg(
        mean("mean_x").alias("all_x"), mean("mean_y").alias("all_y")).select(
            *[F.col(f"_{k}").alias(k) for k in keys], "all_x", "all_y")
    met = F.lit(True)
    for k in keys:
        met = met & F.col(f"_{k}").eqNullSafe(F.col(k))
    dx, dy = F.col("mean_x") - F.col("all_x"), F.col("mean_y") - F.col("all_y")
    return parts.join(whole, met).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.first("all_x").alias("mean_x"), F.first("all_y").alias("mean_y"),
        F.sum(F.col("m2_x") + F.col("n") * dx * dx).alias("m2_x"),
        F.sum(F.col("m2_y") + F.col("n") * dy * dy).alias("m2_y"),
        F.sum(F.col("c_xy") + F.col("n") * dx * dy).alias("c_xy"))


def correlation_of(moments: DataFrame) -> DataFrame:
    """``moments`` plus Pearson's ``r``, null for a constant side or a single row."""
    spread = F.sqrt(F.col("m2_x") * F.col("m2_y"))
    return moments.withColumn("r", F.when((F.col("n") > 1) & (spread > 0), F.greatest(
        F.lit(-1.0), F.least(F.lit(1.0), F.col("c_xy") / spread))))
