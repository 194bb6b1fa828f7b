"""Operator 4: mixing sources to target weights."""

from beatwire.llm.mixing import mix_report
from beatwire.llm.registry import query, table


@query("op4_mixing")
def op4_mixing(spark, sf_dir):
    return mix_report(table(spark, sf_dir, "documents"))
