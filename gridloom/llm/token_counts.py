"""Token counts by rank-synchronous array merging.

Pre-tokens are held as ragged numpy arrays; in each round every sequence
merges all occurrences of its lowest-rank pair, until no pair is left, and the
surviving symbols are counted (``byte_bpe``, ``arrays.merge_rounds``).  One
narrow pass over the texts: no shuffle, nothing broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, text_or_empty

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): bytes, tokens, and whether they exceed ``limit``.

    ``tokenizer`` is the path of a byte-level BPE in a tokenizers .json file,
    or of a SentencePiece BPE .model; begin and end ids are not counted.
    Null and empty texts have 0 bytes and tokens; a null doc_id is kept;
    repeated rows count each; an empty table gives an empty result; columns
    other than doc_id and text are not read.  Texts are whole at any length.
    """

    def make():
        from .byte_bpe import byte_bpe

        from .piece_bpe import piece_bpe

        pieces = tokenizer.endswith(".model")
        bpe = piece_bpe(tokenizer) if pieces else byte_bpe(tokenizer)

        def work(ids, texts):
            n = bpe.encode(texts)[1] - 2 if pieces else bpe.counts(texts)
            return {"doc_id": pa.array(ids, pa.int64()), "n_bytes": np.array([len(t.encode()) for t in texts], np.int64), "n_tokens": n, "over_limit": n > limit}

        return work

    return map_rows(text_or_empty(docs, "doc_id"), make, SCHEMA)
