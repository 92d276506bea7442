"""Lengths of texts in tokens, and token ids in Arrow batches, by the library of the rank files.

Both give the ids that ``bpe.encode`` gives; they are for operators that need sizes or offsets only."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import read_ranks, texts_of


@lru_cache(maxsize=4)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


def sizes(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n bigint): number of ids of each text; 0 for null and empty ones."""
    texts = texts_of(documents, id_col, text_col)

    def count(batches):
        encoder = encoding(path)
        for b in batches:
            n = [len(encoder.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["id", "n"])

    return texts.mapInArrow(count, f"id {dict(texts.dtypes)['id']}, n bigint")
