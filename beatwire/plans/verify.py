"""Claims to verdicts, a batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame

from beatwire.operators.search import (
    TOP_HITS, claim_similarity, claim_verdict, hit_articles, search_corpus,
)
from beatwire.operators.select import split_claims


def verify_claims(claims: DataFrame, corpus: DataFrame, min_len: int = 50, k: int = TOP_HITS,
                  max_keywords: int | None = 10) -> tuple[DataFrame, DataFrame]:
    """Verdicts of the claims that are long enough, and the claims that are not."""
    ok, rejected = split_claims(claims, min_len)
    hits = hit_articles(search_corpus(ok, corpus, k), corpus)
    return claim_verdict(ok, claim_similarity(ok, hits, max_keywords)), rejected
