"""Operator 5: toxicity of restored text."""

from beatwire.llm.registry import query, table
from beatwire.llm.toxicity import fit, score_texts


@query("op5_toxicity")
def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
