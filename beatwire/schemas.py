"""Table schemas and the two schema checks every reader needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLE = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("source", T.StringType()),
])

ARTICLE_WITH_LANGUAGE = T.StructType(
    ARTICLE.fields + [T.StructField("language", T.StringType())])

PAGE = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

CLAIM = T.StructType([
    T.StructField("claim_id", T.LongType()),
    T.StructField("text", T.StringType()),
])

FEED_ITEM = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("pubDate", T.StringType()),
    T.StructField("updated", T.StringType()),
])

# What is read of an RSS item (namespaces ignored) and of an Atom entry.
RSS_ITEM = T.StructType(FEED_ITEM.fields + [
    T.StructField("encoded", T.StringType()),   # content:encoded
    T.StructField("date", T.StringType()),      # dc:date
])
ATOM_ENTRY = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("link", T.ArrayType(T.StructType([
        T.StructField("_href", T.StringType()), T.StructField("_rel", T.StringType())]))),
    T.StructField("published", T.StringType()),
    T.StructField("updated", T.StringType()),
])


def baseline_schema(categories: Sequence[str]) -> T.StructType:
    """Official statistics: a date and one number per category."""
    return T.StructType(
        [T.StructField("date", T.StringType())]
        + [T.StructField(c, T.DoubleType()) for c in categories])


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Fail at plan time, without a job, when a needed column is absent."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")
    return df


def ensure_columns(df: DataFrame, schema: T.StructType,
                   defaults: dict | None = None) -> DataFrame:
    """Add the columns of ``schema`` that ``df`` lacks, as typed nulls or defaults."""
    defaults = defaults or {}
    extra = {
        f.name: F.lit(defaults.get(f.name)).cast(f.dataType)
        for f in schema.fields if f.name not in df.columns
    }
    return df.withColumns(extra) if extra else df
