"""Operator 2: exact de-duplication with filters over a snapshot."""

from pyspark.sql import functions as F

from beatwire.llm.exact_dedup import by_halves, exact_dedup
from beatwire.llm.registry import query, table

SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query("op2_exact_dedup", SQL)
def op2_exact_dedup(spark, sf_dir):
    judged = exact_dedup(table(spark, sf_dir, "documents"), by_halves())
    return judged.select("doc_id", "keep_id", "group_size", "kept",
                         F.lower(F.hex("digest")).alias("text_sha256"))
