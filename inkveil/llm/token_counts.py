"""Token counts of whole texts by a public byte-level BPE vocabulary (method: :mod:`bpe`)."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from inkveil.llm.common import batch_of, id_and_text, text_batches
from inkveil.llm.pieces import ENCODE_BYTES, encoder

VOCABULARY = "byte_bpe_50k.json"
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]
)


def vocabulary_path(name: str) -> str:
    """A path as it is; a bare name is looked up where the task runs."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(
    docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row per input row; ``over_limit`` is ``n_tokens > limit``.

    No begin or end tokens, no truncation; special strings in texts count as the library
    takes them by default (one token). Null texts count as empty (0 bytes, 0 tokens), null
    ids stay null, repeated rows come out as often as they come in, other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary_path(vocabulary), count_only=True)
        for ids, texts in text_batches(batches, ENCODE_BYTES):
            n = encode(texts)
            yield batch_of(SCHEMA, ids, [len(t) for t in texts], n, [k > limit for k in n])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
