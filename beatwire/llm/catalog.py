"""Registered queries of the operators for training text."""

from beatwire.llm.registry import ORACLES, QUERIES

from beatwire.llm import (  # noqa: F401  (registration on import)
    q_byte_bpe, q_conversations, q_exact_dedup, q_html_text, q_licenses, q_merkle, q_minhash, q_mixing, q_packing,
    q_quality, q_token_counts, q_toxicity, q_url_filter,
)

__all__ = ["ORACLES", "QUERIES"]
