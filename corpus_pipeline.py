"""From raw documents to encoded training data, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the ``docs`` of the next one. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from beatwire.llm.byte_bpe import code_docs
from beatwire.llm.exact_dedup import drop_copies
from beatwire.llm.minhash import drop_near_duplicates
from beatwire.llm.mixing import take_mix
from beatwire.llm.quality import filter_quality
from beatwire.session import written

VOCABULARY = "byte_bpe_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the cascade of quality rules."""
    return filter_quality(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest id."""
    return drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return take_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded_sha256); the digest is of the decoded ids."""
    return code_docs(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN,
                     keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("minhash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("byte-level bpe", encode),
]

# Hashed permutations and token ids are beyond SQL; tests/llm compares with a
# version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
