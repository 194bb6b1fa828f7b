"""Unions, keep-first de-duplication and caps.

Every "first k of a group" is written as ``row_number() <= k``: Spark then
keeps k rows per group in each task before the shuffle, so a group that holds
a third of all rows (articles without an address, say) sends k rows per task.
Spark does so up to a k of 1,000. Beyond, rows are dealt out by ranges of their
order, and counts tell which ranges are kept whole and where the border lies.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from beatwire.session import written


def union_sources(*dfs: DataFrame) -> DataFrame:
    """All rows, columns by name, missing ones null; ``source_rank`` is the position."""
    ranked = [d.withColumn("source_rank", F.lit(i)) for i, d in enumerate(dfs)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
BROADCAST_RANGES = 200_000  # (range, group) pairs that are broadcast; beyond, the join shuffles
PART_BITS = 33  # monotonically_increasing_id: the part above, the row in it below


def first_many(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of every group, for any k; null keys form one group.

    Rows are dealt out by ranges of group and order and sorted within their
    range; a group may fill many. The rows of a group in front of a range are
    known from counts, so a row's place follows from its place in the range and
    no task holds more than a range.
    """
    place = [*[F.asc(key) for key in keys], *order]
    sides = {key: f"_right_{key}" for key in keys}
    dealt = written(df.repartitionByRange(*place).sortWithinPartitions(*place)
                    .withColumn("_row", F.monotonically_increasing_id()), "ranges")
    dealt = dealt.withColumn("_range", F.shiftright("_row", PART_BITS))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = written(
        dealt.groupBy(*keys, "_range").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .where(F.col("_before") < k)
        .select(*[F.col(key).alias(side) for key, side in sides.items()],
                F.col("_range").alias("_at"), "_first", "_before"), "kept-ranges")
    if ranges.count() <= BROADCAST_RANGES:
        ranges = F.broadcast(ranges)
    met = reduce(lambda a, key: a & F.col(key).eqNullSafe(F.col(sides[key])), keys,
                 F.col("_range") == F.col("_at"))
    return (dealt.join(ranges, met).where(F.col("_row") - F.col("_first") + F.col("_before") < k)
            .select(*df.columns))


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first k rows of every group; null keys form one group."""
    if k > int(df.sparkSession.conf.get(GROUP_LIMIT, "1000")):
        return first_many(df, keys, order, k)
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def cap_dedupe(df: DataFrame, group: str, key: str, cap: int, group_order: str, order: str,
               how: str) -> DataFrame:
    """Cap per group and de-duplicate by key, in either order.

    ``cap_first``: first rows of each group, then one row per key over all
    groups in group order; a lost duplicate is not replaced.
    ``dedupe_first``: one row per key within the group, then the cap.
    """
    if how == "cap_first":
        capped = first_per(df, [group], [F.asc(order)], cap)
        return first_per(capped, [key], [F.asc(group_order), F.asc(order)])
    if how == "dedupe_first":
        single = first_per(df, [group, key], [F.asc(order)])
        return first_per(single, [group], [F.asc(order)], cap)
    raise ValueError(f"unknown order of steps {how!r}")


def merge_order(df: DataFrame, order: Sequence[str] = ("ord",)) -> list[Column]:
    """Newest batch first, then ``order``, nulls last; all other columns decide ties."""
    place = ["batch_rank", *order]
    others = sorted(f.name for f in df.schema.fields
                    if f.name not in place and f.dataType.typeName() != "map")
    return [F.asc_nulls_last(c) for c in (*place, *others)]


def dedupe_keep_newest(df: DataFrame, key: str = "url",
                       order: Sequence[str] = ("ord",)) -> DataFrame:
    """One row per key: the one of the newest batch, then the first in it.

    Null keys are one key. A table without the column keeps all its rows.
    """
    return first_per(df, [key], merge_order(df, order)) if key in df.columns else df


def merge_batch(new: DataFrame, old: DataFrame | None, key: str = "url",
                order: Sequence[str] = ("ord",), cap: int | None = 500,
                first_run_raw: bool = False) -> DataFrame:
    """New rows before old ones, one row per key, the first ``cap`` of those.

    The columns ``order`` are the place of a row in its batch; places may
    repeat or be null (those come last). Either batch is read once; every task
    keeps one row per key before the shuffle and the first ``cap`` after it.
    ``first_run_raw`` leaves a first batch as is.
    """
    if old is None and first_run_raw:
        return new.withColumn("batch_rank", F.lit(0))
    batches = [new.withColumn("batch_rank", F.lit(0))]
    if old is not None:
        batches.append(old.drop("batch_rank").withColumn("batch_rank", F.lit(1)))
    rows = dedupe_keep_newest(
        reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches), key, order)
    return rows if cap is None else rows.orderBy(*merge_order(rows, order)).limit(cap)


def with_fallback(stored: DataFrame | None, others: Sequence[DataFrame],
                  min_rows: int = 5) -> DataFrame | None:
    """The stored corpus, or the union of other collections when it is too small.

    Empty collections are skipped; with none left the stored corpus is
    returned as it is. Each check reads at most ``min_rows`` rows.
    """
    if stored is not None and len(stored.take(min_rows)) >= min_rows:
        return stored
    usable = [d for d in others if not d.isEmpty()]
    return union_sources(*usable).drop("source_rank") if usable else stored
