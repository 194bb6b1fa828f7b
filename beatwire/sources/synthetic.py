"""Made-up but repeatable articles and statistics, keyed by given rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatwire.dims import FALLBACK_LABEL, FILLER, TAX6, VOCAB6
from beatwire.functions.draws import digest, draw, unit
from beatwire.functions.text import title_case

FILLER_WORDS = 15
DIGEST_LENGTH = 32


def _shuffled(items: Column, seed: int, *key) -> Column:
    """Items ordered by a digest of key, place and item."""
    tagged = F.transform(items, lambda w, i: F.concat(digest(seed, *key, i, w), w))
    return F.transform(F.array_sort(tagged), lambda w: F.substr(w, F.lit(DIGEST_LENGTH + 1)))


def synthetic_articles(keys: DataFrame, key: str, seed: int = 42,
                       vocab: Mapping[str, Sequence[str]] = VOCAB6,
                       categories: Sequence[str] = TAX6) -> DataFrame:
    """One labelled article per key, every draw a function of seed and key.

    One or two categories (odds 3:2), the fallback label only by itself; three
    to six words of each category and fifteen filler words, shuffled. The
    whole is a projection: no shuffle, and any row can be rebuilt alone.
    """
    k = F.col(key)
    drawn = F.slice(
        _shuffled(F.array(*[F.lit(c) for c in categories]), seed, k, "label"), F.lit(1),
        F.when(draw(seed, k, "labels") % 5 < 3, F.lit(1)).otherwise(F.lit(2)))
    labels = F.when(F.array_contains(drawn, FALLBACK_LABEL),
                    F.array(F.lit(FALLBACK_LABEL))).otherwise(drawn)
    picked = [
        F.when(F.array_contains(F.col("labels"), c), F.slice(
            _shuffled(F.array(*[F.lit(w) for w in vocab[c]]), seed, k, c), F.lit(1),
            (3 + draw(seed, k, c, "n") % 4).cast("int"))).otherwise(
                F.array().cast("array<string>"))
        for c in categories]
    filler = F.transform(
        F.sequence(F.lit(0), F.lit(FILLER_WORDS - 1)),
        lambda i: F.element_at(F.array(*[F.lit(w) for w in FILLER]),
                               (draw(seed, k, "filler", i) % len(FILLER) + 1).cast("int")))
    body = _shuffled(F.concat(*picked, filler), seed, k, "order")
    day = F.concat(
        F.lit("2023-"), F.lpad((draw(seed, k, "month") % 12 + 1).cast("string"), 2, "0"),
        F.lit("-"), F.lpad((draw(seed, k, "day") % 28 + 1).cast("string"), 2, "0"))
    return (keys.select(k, labels.alias("labels"))
            .select(k, "labels", body.alias("body"))
            .select(
                k,
                title_case(F.array_join(F.slice("body", 1, 3), " ")).alias("title"),
                F.array_join("body", " ").alias("clean_text"),
                day.alias("date"),
                F.concat(F.lit("http://example.com/news/"), k.cast("string")).alias("url"),
                *[F.array_contains("labels", c).cast("int").alias(c) for c in categories]))


def mock_baseline(trend: DataFrame, categories: Sequence[str], on: str = "month_end",
                  seed: int = 42) -> DataFrame:
    """Statistics made from a trend: each value scaled by 0.8-1.2, moved by -2 to 2."""
    month = F.date_format(on, "yyyy-MM-dd")
    return trend.select(on, *[
        F.greatest(
            F.lit(0.0),
            F.col(c) * (F.lit(0.8) + F.lit(0.4) * unit(seed, month, c, "scale"))
            + (draw(seed, month, c, "shift") % 5 - 2)).alias(c)
        for c in categories])
