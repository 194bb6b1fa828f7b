"""Rows that are counted on the way and handed back as often as they came."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AT_ONCE = 10_000


def repeated(df: DataFrame, count: str, copy: str = "copy") -> DataFrame:
    """Every row as many times as ``count`` says, with ``copy`` from 0.

    Two steps, so that no row ever carries an array of more than 10,000 numbers
    (or the square root of that count, for very large counts).
    """
    block, n = "__block", F.col(count).cast("long")
    width = F.greatest(F.lit(AT_ONCE).cast("long"), F.ceil(F.sqrt(n)).cast("long"))
    first = F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / width).cast("long"))
    left = n - 1 - F.col(block) * width
    return (df.where(n > 0).withColumn(block, F.explode(first))
            .withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"),
                                                   F.least(left, width - 1))))
            .withColumn(copy, F.col(copy) + F.col(block) * width).drop(block))
