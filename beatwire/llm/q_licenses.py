"""Operator 10: licence notices by exact seeds and bounded-error matching."""

from beatwire.llm.licenses import license_report
from beatwire.llm.registry import query, table


@query("op10_licenses")
def op10_licenses(spark, sf_dir):
    return license_report(table(spark, sf_dir, "documents"))
