"""Token counts: lengths only, of whole texts, in Arrow functions.

Each Arrow batch is dealt into slices of about SLICE_BYTES of text, so that a
slice costs about the same whatever its rows; texts are cut at boundaries that
no token crosses (see tokens.py), each distinct segment of a slice is encoded
once, and only lengths go back. Rows are neither shuffled nor gathered.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows
are counted each; further columns of the input are left out; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, bounded_batches, by_bytes
from .tokens import SLICE_BYTES, Encoder


def token_counts(df: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of each row; tokenizer: path of a .json (tokenizers) or .model (sentencepiece) file on every machine."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("tokens")
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE_BYTES):
                n = encoder.lengths(part.column("text"))
                size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), size, pa.array(n, pa.int64()), pa.array(np.greater(n, limit))], ["id", "n_bytes", "n_tokens", "over_limit"])

    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
