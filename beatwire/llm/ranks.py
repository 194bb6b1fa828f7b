"""Places of rows in a total order, without putting an order's rows into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beatwire.session import written

BROADCAST_STARTS = 200_000  # (part, group) pairs that are broadcast; beyond, the join shuffles
PART_BITS = 33  # monotonically_increasing_id: the part above, the row in it below


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], few: int) -> DataFrame:
    """Inner join on ``keys``, null equal to null; ``right`` is a written table and is
    broadcast if it counts at most ``few`` rows."""
    side = right.select(*[F.col(c).alias(f"__right_{c}" if c in keys else c)
                          for c in right.columns])
    if right.count() <= few:
        side = F.broadcast(side)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__right_{k}"))
    return left.join(side, cond).drop(*[f"__right_{k}" for k in keys])


def ranked(rows: DataFrame, order: Sequence[str], within: Sequence[str] = (),
           place: str = "place") -> DataFrame:
    """``rows`` plus ``place``, from 0 in each group of ``within``, nulls first.

    The rows are dealt out by ranges of (within, order), sorted in their part
    and kept as a table with their number; the parts' counts tell how many rows
    of a group lie in front of a part. A group, or one value of the order, may
    hold any share of the rows: the number of a row as read breaks ties, so that
    equal rows spread over parts, too. ``rows`` should be a written table.
    """
    keys, tie, number, part = [*within, *order], "__tie", "__number", "__part"
    dealt = rows.withColumn(tie, F.monotonically_increasing_id())
    kept = written(dealt.repartitionByRange(*keys, tie).sortWithinPartitions(*keys, tie)
                   .drop(tie).withColumn(number, F.monotonically_increasing_id()), "ranked")
    kept = kept.withColumn(part, F.shiftright(number, PART_BITS))
    before = Window.partitionBy(*within).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = written(
        kept.groupBy(part, *within).agg(F.min(number).alias("__first"), F.count("*").alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))), "starts")
    joined = matched(kept, starts, [part, *within], BROADCAST_STARTS)
    return joined.select(*rows.columns,
                         (F.col(number) - F.col("__first") + F.col("__before")).alias(place))
