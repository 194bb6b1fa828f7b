"""Articles at rest: clean, route, label, place, count, compare."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatwire.dims import gazetteer
from beatwire.functions.text import PARITY_SCRIPTS, clean_text, detect_language
from beatwire.operators.classify import Scorer, classify
from beatwire.operators.correlate import align_months, correlate
from beatwire.operators.geo import geocode_articles
from beatwire.operators.select import drop_empty_clean, label_lite, settled
from beatwire.operators.trend import trend
from beatwire.schemas import ARTICLE, ensure_columns, require_columns


def clean_articles(raw: DataFrame, scripts: Sequence[str] = PARITY_SCRIPTS,
                   keep_language: bool = False) -> DataFrame:
    """Articles with ``clean_text`` and ``lang``; rows that clean to nothing are dropped.

    With ``keep_language`` a language stated by the source wins over the
    detected one.
    """
    # an address is not made up: a table without one is merged without de-duplication
    schema = ARTICLE if "url" in raw.columns else T.StructType(
        [f for f in ARTICLE.fields if f.name != "url"])
    df = ensure_columns(require_columns(raw, ["text"]), schema)
    df = drop_empty_clean(settled(df, {"clean_text": clean_text(F.col("text"), scripts)}))
    lang = detect_language(F.col("clean_text"))
    if keep_language and "language" in df.columns:
        lang = F.coalesce("language", lang)
    return df.withColumn("lang", lang)


def label_articles(clean: DataFrame, categories: Sequence[str], scorer: Scorer | None = None,
                   mode: str = "parity") -> DataFrame:
    """Flags and coordinates; without a scorer every article is ``non_crime``."""
    labelled = (label_lite(clean, categories) if scorer is None
                else classify(clean, scorer, categories))
    return geocode_articles(labelled, gazetteer(), mode)


def trend_and_correlation(labelled: DataFrame, categories: Sequence[str],
                          baseline: DataFrame | None = None, mode: str = "by_month",
                          strict: bool = False,
                          position: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Monthly counts and their correlation with official statistics.

    Without statistics there is nothing to compare, and the second table is empty.
    """
    monthly = trend(labelled, categories, strict=strict)
    if baseline is None:
        none = [F.lit(0.0).alias(c) for c in categories]
        baseline = monthly.select(F.col("month_end").alias("date"), *none).limit(0)
        mode = "by_month"
    return monthly, correlate(align_months(monthly, baseline, mode, position=position))
