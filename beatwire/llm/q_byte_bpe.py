"""Operator 3: byte-level BPE encoding and decoding."""

import public_tokenizers

from beatwire.llm.byte_bpe import digest_docs
from beatwire.llm.registry import query, table

VOCABULARY = "byte_bpe_50k.tiktoken"


@query("op3_byte_bpe")
def op3_byte_bpe(spark, sf_dir):
    return digest_docs(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY),
                       public_tokenizers.PATTERN)
