"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by their encoded length; running sums over the
histogram then answer totals, quantiles and truncated totals for every context
limit without reading a text again. Lengths are summed in blocks of 1,024, so
no task holds more than one block, or one row per block.

Defined cases: null and empty texts have length 0 and count as documents; texts
are encoded whole; every row counts, repeated ones too; an empty table gives an
empty histogram; columns other than the text are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatwire.llm.byte_bpe import read_ranks

BLOCK = 1_024
_LOADED: dict[tuple, tiktoken.Encoding] = {}


def _encoding(ranks: dict[bytes, int], pattern: str) -> tiktoken.Encoding:
    key = (len(ranks), hash(frozenset(ranks.items())), pattern)
    if key not in _LOADED:
        _LOADED[key] = tiktoken.Encoding("lengths", pat_str=pattern, mergeable_ranks=ranks,
                                         special_tokens={})
    return _LOADED[key]


def token_counter(vocabulary: str, pattern: str):
    """A column function, text -> number of ids; special tokens are ordinary text."""
    ranks = read_ranks(vocabulary)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(ranks, pattern).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count


def length_histogram(docs: DataFrame, length: Column) -> DataFrame:
    """(n_tokens, n_docs): exact, added up in every task before the shuffle."""
    return docs.select(length.alias("n_tokens")).groupBy("n_tokens").agg(
        F.count("*").alias("n_docs"))


def limit_table(histogram: DataFrame) -> DataFrame:
    """What every context limit that occurs as a length keeps.

    For a limit of ``n_tokens``: documents and tokens up to it, documents beyond
    it, tokens that are left if longer ones are cut, and the share of documents
    up to it. Between two rows the number of kept tokens grows in a line.
    """
    h = histogram.withColumn("block", F.expr(f"n_tokens div {BLOCK}"))
    tokens = F.col("n_tokens") * F.col("n_docs")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding,
                                                Window.unboundedFollowing)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"),
                           F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"),
                           F.sum("d").over(whole).alias("all_docs"),
                           F.sum("t").over(whole).alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(
        Window.unboundedPreceding, 0)
    up_to = (h.join(blocks, "block")
             .withColumn("docs_up_to", F.sum("n_docs").over(inside) + F.col("d0"))
             .withColumn("tokens_up_to", F.sum(tokens).over(inside) + F.col("t0")))
    longer = F.col("all_docs") - F.col("docs_up_to")
    return up_to.select(
        "n_tokens", "n_docs", "docs_up_to", longer.alias("docs_longer"), "tokens_up_to",
        (F.col("tokens_up_to") + F.col("n_tokens") * longer).alias("kept_tokens"), "all_tokens",
        (F.col("docs_up_to") / F.col("all_docs")).alias("share_up_to"))


def truncated_totals(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context, kept_tokens) for any limits, in one pass over the histogram."""
    kept = [F.struct(F.lit(n).cast("long").alias("context"), F.coalesce(F.sum(
        F.col("n_docs") * F.least(F.col("n_tokens"), F.lit(n))), F.lit(0)).alias("kept_tokens"))
        for n in limits]
    return histogram.agg(F.array(*kept).alias("a")).select(F.inline("a"))


def length_quantiles(limits: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that so many documents do not exceed."""
    least = [F.struct(F.lit(float(s)).alias("share"), F.min(F.when(
        F.col("share_up_to") >= s, F.col("n_tokens"))).alias("n_tokens")) for s in shares]
    return limits.agg(F.array(*least).alias("a")).select(F.inline("a"))
