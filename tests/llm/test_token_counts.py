from collections import Counter
from pathlib import Path

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from beatwire.llm.byte_bpe import read_ranks
from beatwire.llm.catalog import QUERIES
from beatwire.llm.token_counts import (length_histogram, length_quantiles, limit_table,
                                       token_counter, truncated_totals)

PATH = P.path("byte_bpe_50k.tiktoken")
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(PATH),
                            special_tokens={})


def check(rows, lengths):
    counts, n, total = Counter(lengths), len(lengths), sum(lengths)
    assert sorted(r.n_tokens for r in rows) == sorted(counts)
    for r in rows:
        short = [x for x in lengths if x <= r.n_tokens]
        assert (r.n_docs, r.docs_up_to, r.docs_longer) == (counts[r.n_tokens], len(short),
                                                           n - len(short))
        assert (r.tokens_up_to, r.all_tokens) == (sum(short), total)
        assert r.kept_tokens == sum(min(x, r.n_tokens) for x in lengths)
        assert r.share_up_to == len(short) / n


def test_against_the_library(docs_of):
    texts = ["", None, "a", "a", "<|endoftext|>", "ab " * 40_000, "é" * 500, "x y z", "x y z"]
    docs = docs_of(*enumerate(texts), (None, "x y z"), extra="n_tokens n_docs block")
    hist = length_histogram(docs, token_counter(PATH, P.PATTERN)(F.col("text")))
    lengths = [len(LIBRARY.encode_ordinary(t or "")) for t in texts + ["x y z"]]
    check(limit_table(hist).collect(), lengths)
    limits = [0, 1, 2, 100, 10**6]
    got = {r.context: r.kept_tokens for r in truncated_totals(hist, limits).collect()}
    assert got == {n: sum(min(x, n) for x in lengths) for n in limits}
    shares = {r.share: r.n_tokens for r in length_quantiles(limit_table(hist), [.1, .5, 1]).collect()}
    assert shares == {q: min(x for x in lengths if sum(y <= x for y in lengths) / len(lengths) >= q)
                      for q in (.1, .5, 1)}


def test_blocks_of_lengths(spark):
    lengths = [i * i % 9_973 for i in range(3_000)]
    df = spark.createDataFrame([(x,) for x in lengths], "x long")
    check(limit_table(length_histogram(df, F.col("x"))).collect(), lengths)


def test_empty_table(docs_of):
    hist = length_histogram(docs_of((1, "x")).limit(0), F.length("text").cast("long"))
    assert limit_table(hist).collect() == []
    assert [tuple(r) for r in truncated_totals(hist, [5]).collect()] == [(5, 0)]


def test_query_against_the_library(spark):
    tables = Path("/root/testdata/sf0.001")
    if not tables.exists():
        pytest.skip("no test tables")
    texts = [r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    check(QUERIES["op9_token_counts"](spark, str(tables)).collect(),
          [len(LIBRARY.encode_ordinary(t or "")) for t in texts])
