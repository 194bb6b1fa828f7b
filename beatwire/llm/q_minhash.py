"""Operator 7: MinHash near-duplicates."""

from beatwire.llm.minhash import near_duplicates
from beatwire.llm.registry import query, table


@query("op7_minhash")
def op7_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
