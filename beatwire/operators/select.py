"""Filters, projections and top-k reports over articles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatwire.dims import CRITICAL, FALLBACK_LABEL, INDIC_LANGS, MAP_CENTER
from beatwire.functions.labels import alert_message, flagged, key_of
from beatwire.session import written

ALL_SOURCES = "All Sources"
ALL_CATEGORIES = "All Categories"


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns``, each computed once whatever is done with them.

    The optimizer copies a column into every filter on it, and moves the filter
    below; it does not move one below a generator. For columns dear to compute.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.drop(*columns).select("*", F.inline(F.array(row)))


def drop_empty_clean(df: DataFrame, col: str = "clean_text") -> DataFrame:
    return df.where(F.length(col) > 0)


def filter_source(df: DataFrame, names: str | Sequence[str] = ALL_SOURCES) -> DataFrame:
    """Rows of one or several sources; ``All Sources`` keeps everything."""
    if names == ALL_SOURCES:
        return df
    return df.where(F.col("source").isin([names] if isinstance(names, str) else list(names)))


def filter_category(df: DataFrame, display: str = ALL_CATEGORIES) -> DataFrame:
    """Rows flagged with the category of that display name.

    A name without a column filters nothing.
    """
    key = key_of(display)
    if display == ALL_CATEGORIES or key not in df.columns:
        return df
    return df.where(F.col(key) == 1)


def map_points(df: DataFrame, center: bool = False) -> DataFrame:
    """Rows with both coordinates; with ``center`` one default point when none has."""
    cols = ["title", "source", "location", "lat", "lon"]
    points = df.dropna(subset=["lat", "lon"]).select(*cols)
    if not center:
        return points
    none = F.lit(None).cast("string")
    default = df.sparkSession.range(1).select(
        none.alias("title"), none.alias("source"), none.alias("location"),
        F.lit(MAP_CENTER[0]).alias("lat"), F.lit(MAP_CENTER[1]).alias("lon"))
    return points.unionByName(default.where(~points.exists()))


def split_claims(df: DataFrame, min_len: int = 50,
                 col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Claims long enough to check, and the rest."""
    enough = F.coalesce(F.length(col) >= min_len, F.lit(False))
    return df.where(enough), df.where(~enough)


def route_language(df: DataFrame, lang: str = "lang") -> DataFrame:
    """Add ``route``: ``indic`` for Indian languages, else ``general``."""
    if lang not in df.columns:
        df = df.withColumn(lang, F.lit("en"))
    return df.withColumn(
        "route", F.when(F.col(lang).isin(INDIC_LANGS), "indic").otherwise("general"))


def route_or_all(df: DataFrame, route: str, min_rows: int) -> DataFrame:
    """Rows of a route, or every row when the route has fewer than ``min_rows``.

    The size is a scalar subquery; it stops counting at ``min_rows``.
    """
    subset = df.where(F.col("route") == route)
    size = subset.select(F.lit(1).alias("one")).limit(min_rows).agg(
        F.count(F.lit(1)).alias("n")).scalar()
    return df.where((F.col("route") == route) | (size < min_rows))


def label_lite(df: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Flags without scoring: all 0, the fallback 1."""
    return df.withColumns(
        {c: F.lit(1 if c == FALLBACK_LABEL else 0) for c in categories})


def sample_records(df: DataFrame, order: str, n: int = 3, width: int = 70,
                   col: str = "clean_text") -> DataFrame:
    """The first texts, cut to a line for printing."""
    return (df.orderBy(order).limit(n)
            .select(order, F.left(col, F.lit(width)).alias("sample")))


def live_feed(df: DataFrame, order: str, n: int = 20) -> DataFrame:
    """Newest first, ``n`` rows, each with "showing x of y"."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (df.orderBy(F.desc_nulls_last("date"), F.asc(order)).limit(n)
            .withColumn("n_total", total)
            .withColumn("n_shown", F.least(F.lit(n).cast("bigint"), F.col("n_total"))))


def browse(df: DataFrame, order: str, source: str | Sequence[str] = ALL_SOURCES,
           category: str = ALL_CATEGORIES, n: int = 20,
           columns: Sequence[str] = ("title", "date", "url", "source")) -> DataFrame:
    """What a reader pages through: the filters, newest first, ``n`` rows of so many.

    The table is read and filtered once; of what passes, the shown columns are
    kept as a table that gives both the number of rows and the first of them.
    """
    passed = filter_category(filter_source(df, source), category)
    kept = written(passed.select(order, *[c for c in columns if c != order]), "browsed")
    return live_feed(kept, order, n)


def with_alert(df: DataFrame, keys: Sequence[str] = CRITICAL) -> DataFrame:
    """Rows flagged with a critical category, with the matched names and a message."""
    matched = flagged(keys)
    any_set = F.lit(False)
    for k in keys:
        any_set = any_set | (F.col(k) == 1)
    return (df.where(any_set).withColumn("matched", matched)
            .withColumn("message", alert_message(F.col("title"), F.col("matched"))))


def critical_alerts(df: DataFrame, order: str, keys: Sequence[str] = CRITICAL,
                    k: int = 5) -> DataFrame:
    """The first ``k`` alerts in table order."""
    return with_alert(df, keys).orderBy(order).limit(k).select(order, "matched", "message")


def preview(df: DataFrame, order: str, n: int = 100) -> DataFrame:
    return df.orderBy(order).limit(n)


def source_options(df: DataFrame) -> DataFrame:
    """Choices of the source filter: the catch-all first, then names in order."""
    names = df.where(F.col("source").isNotNull()).select("source").distinct()
    first = df.sparkSession.range(1).select(F.lit(ALL_SOURCES).alias("source"))
    return (first.withColumn("rank", F.lit(0))
            .unionByName(names.withColumn("rank", F.lit(1)))
            .orderBy("rank", "source"))
