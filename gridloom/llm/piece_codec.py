"""SentencePiece encoding and decoding of documents (``piece_bpe``): one narrow pass, no shuffle."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import offsets
from .common import map_rows, text_or_empty, with_package

SCHEMA = "doc_id long, ids array<int>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _codec(model: str):
    from .piece_bpe import piece_bpe

    return piece_bpe(model)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, decoded) for each row of ``docs``: the ids with begin and end id, and the text decoded from them.

    Null and empty texts give the begin and end id and the empty text; a null
    doc_id is kept; repeated rows give repeated results; very long texts are
    encoded whole, a block of their own; an empty table gives none; columns
    other than doc_id and text are not read.
    """

    def make():
        codec = _codec(model)

        def work(ids, texts):
            out, n = codec.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(offsets(n), pa.int32()), pa.array(out, pa.int32()))
            return {"doc_id": pa.array(ids, pa.int64()), "ids": lists, "decoded": pa.array([t.decode() for t in codec.decode(out, n)], pa.string())}

        return work

    return map_rows(text_or_empty(docs, "doc_id"), make, SCHEMA)


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode``'s rows; ids count as little-endian unsigned 32-bit integers."""

    def run(batches):
        import hashlib

        for b in batches:
            lists, start = b.column("ids"), b.column("ids").offsets.to_pylist()
            data = lists.values.to_numpy().astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([t - s for s, t in zip(start, start[1:], strict=False)], pa.int64()), pa.array([hashlib.sha256(data[s:t].tobytes()).hexdigest() for s, t in zip(start, start[1:], strict=False)]), pa.array([hashlib.sha256(x.as_py().encode()).hexdigest() for x in b.column("decoded")])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return with_package(encoded).mapInArrow(run, DIGESTS)
