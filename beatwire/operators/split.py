"""Train and test parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from beatwire.functions.draws import digest, unit


def split_exact(df: DataFrame, key: str, frac: float = 0.8, seed: int = 42,
                digits: int = 4) -> DataFrame:
    """Add ``part``: exactly floor(frac * n) rows ``train``, the rest ``test``.

    Rows are ranked by a digest of their key without a global sort. The first
    ``digits`` hexadecimal digits of the digest name a bucket; bucket sizes,
    at most 16**digits rows, tell in which bucket the border lies. Rows of
    every other bucket are placed by comparison alone; only the border bucket,
    a 16**digits-th of the rows, is ranked.
    """
    hashed = df.withColumn("_d", digest(seed, F.col(key))).withColumn(
        "_b", F.left("_d", F.lit(digits)))
    sizes = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("n"))
    running = W.orderBy("_b")
    placed = sizes.select(
        "_b", F.sum("n").over(running).alias("upto"), "n",
        F.floor(F.lit(frac) * F.sum("n").over(W.partitionBy())).alias("target"))
    edge = (placed.where(F.col("upto") > F.col("target"))
            .agg(F.min(F.struct("_b", (F.col("upto") - F.col("n")).alias("before"),
                                "target")).alias("edge")).scalar())
    marked = hashed.withColumn("_edge", edge)
    border = F.coalesce(F.col("_b") == F.col("_edge._b"), F.lit(False))
    clear = marked.where(~border).withColumn(
        "part", F.when(F.col("_edge").isNull() | (F.col("_b") < F.col("_edge._b")),
                       "train").otherwise("test"))
    rank = F.row_number().over(W.partitionBy("_b").orderBy("_d", key))
    ranked = marked.where(border).withColumn(
        "part", F.when(F.col("_edge.before") + rank <= F.col("_edge.target"),
                       "train").otherwise("test"))
    return clear.unionByName(ranked).drop("_d", "_b", "_edge")


def split_approx(df: DataFrame, key: str, frac: float = 0.8, seed: int = 42) -> DataFrame:
    """The same within sampling error, as a projection."""
    return df.withColumn(
        "part", F.when(unit(seed, F.col(key)) < frac, "train").otherwise("test"))


def split_sizes(df: DataFrame) -> DataFrame:
    """Rows per route and part."""
    return df.groupBy("route", "part").agg(F.count(F.lit(1)).alias("n"))
