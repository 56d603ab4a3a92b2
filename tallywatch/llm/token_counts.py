"""Token counts by a compiled finite-state tokenizer."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import batches as B
from .vocabulary import find
from .word_symbols import WordSymbols

WORD_VOCABULARY = "word_bpe_49k.json"
_machines: dict[str, WordSymbols] = {}


def machine(vocabulary: str) -> WordSymbols:
    """The compiled tokenizer of a file, kept for the life of the process."""
    if vocabulary not in _machines:
        _machines[vocabulary] = WordSymbols(find(vocabulary))
    return _machines[vocabulary]


def count_tokens(docs: DataFrame, vocabulary: str = WORD_VOCABULARY, limit: int = 2048) -> DataFrame:
    """UTF-8 bytes and tokens of each document, and whether the tokens exceed ``limit``.

    One row for each input row, repeated or not, in one pass without a shuffle.
    A null or empty text has 0 bytes and 0 tokens. A null doc_id is kept. Very
    long texts are counted whole. Other columns are not read.
    """
    def count(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = machine(vocabulary)
        for part in B.slices(parts, most=2 << 20):
            _, bounds = B.flat_bytes(part.column("text"))
            tokens = tokenizer.count(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return B.id_and_text(docs).mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
