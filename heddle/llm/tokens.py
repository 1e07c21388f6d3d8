"""Token counts of whole texts (rank-synchronous array merging, see bpe.py)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from heddle.llm.bpe import encoder
from heddle.llm.common import id_and_text, in_arrow, slices, strings

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, slice_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs``.

    One narrow pass, no shuffle; a worker holds one slice of texts and a bounded table of ids.
    A null text counts as empty (0 bytes, 0 tokens); an empty table gives an empty result;
    repeated rows are counted each; other columns of any name are ignored. The vocabulary file
    must lie at the same path on every executor.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        for piece in slices(batches, "text", slice_bytes):
            texts = strings(piece.column("text"))
            sizes = [len(x) // 4 for x in encode(texts)]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([n > limit for n in sizes], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return in_arrow(id_and_text(docs), count, SCHEMA)
