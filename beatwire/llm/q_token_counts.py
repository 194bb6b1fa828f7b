"""Operator 9: token counts from a histogram of encoded lengths."""

import public_tokenizers
from pyspark.sql import functions as F

from beatwire.llm.registry import query, table
from beatwire.llm.token_counts import length_histogram, limit_table, token_counter
from beatwire.session import written

VOCABULARY = "byte_bpe_50k.tiktoken"


@query("op9_token_counts")
def op9_token_counts(spark, sf_dir):
    count = token_counter(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    lengths = length_histogram(table(spark, sf_dir, "documents"), count(F.col("text")))
    return limit_table(written(lengths, "histogram"))  # read twice, texts once
