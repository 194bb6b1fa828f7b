"""Operator 13: best-fit packing of token sequences."""

import public_tokenizers

from beatwire.llm.packing import pack_docs
from beatwire.llm.registry import query, table

VOCABULARY = "word_bpe_49k.json"


@query("op13_packing")
def op13_packing(spark, sf_dir):
    return pack_docs(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
