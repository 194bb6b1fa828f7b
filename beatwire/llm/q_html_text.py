"""Operator 1: main text of pages by a maximum-scoring run."""

from beatwire.llm.html_text import extract_text
from beatwire.llm.registry import query, table


@query("op1_html_text")
def op1_html_text(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))
