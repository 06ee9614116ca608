"""Token counts of documents by rank-synchronous array merging."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bpe import TokenCounter
from plumbline.llm.common import small_batches
from plumbline.llm.wordhash import slices

_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One counter a worker process and vocabulary file."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of docs.

    vocabulary: path of a byte-level BPE file of the tokenizers library, the same on every
    executor. Null and empty text have 0 bytes and 0 tokens; a null id stays null; equal
    rows give equal results, each its own row; an empty table gives an empty one; other
    columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                n_bytes = pc.binary_length(part.column("text").cast(pa.large_binary())).fill_null(0).cast(pa.int64())
                n_tokens = pa.array(tokens.counts(part.column("text")), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), n_bytes, n_tokens], ["doc_id", "n_bytes", "n_tokens"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
