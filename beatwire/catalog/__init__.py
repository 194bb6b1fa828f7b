"""Registered queries over the given tables, each with its SQL counterpart."""

from beatwire.catalog.registry import ORACLES, QUERIES

from beatwire.catalog import (  # noqa: F401  (registration on import)
    q_analysis, q_articles, q_claims, q_classify, q_geo, q_ingest, q_language, q_merge, q_plans, q_streams,
)

__all__ = ["ORACLES", "QUERIES"]
