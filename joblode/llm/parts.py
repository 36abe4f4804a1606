"""Texts of Arrow batches as bytes, in parts of bounded size, and their words as numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblode.llm.common import fresh, quoted

PART_BYTES = 1_000_000


def with_bytes(docs: DataFrame, text: str, keep: tuple[str, ...]) -> tuple[DataFrame, str]:
    """The columns to keep and, last, the text as UTF-8 bytes under a name of its own."""
    (body,) = fresh(docs, "text_bytes")
    return docs.select(*(quoted(c) for c in keep), quoted(text).cast("string").cast("binary").alias(body)), body


def byte_parts(batch: pa.RecordBatch, column: str, limit: int = PART_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch with at most so many bytes of text (or one row), and the texts; null texts are empty."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = size = 0
    for i, own in enumerate([*sizes, limit + 1]):
        if i > start and size + own > limit:
            part = batch.slice(start, i - start)
            yield part, [t or b"" for t in part.column(column).to_pylist()]
            start, size = i, 0
        size += own


def ddl(df: DataFrame, names: tuple[str, ...]) -> str:
    return ", ".join(f"`{df.schema[n].name}` {df.schema[n].dataType.simpleString()}" for n in names)


def number_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, list[bytes]]:
    """All words of the texts in a row, their codes (equal words, equal codes), the words of each text, distinct words.

    A word is a run of bytes other than space and the controls 9 to 13, which is what bytes.split() cuts at.
    """
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = [x for w in words for x in w]
    if not flat:
        return flat, np.zeros(0, np.int64), sizes, []
    codes, names = pd.factorize(np.array(flat, dtype=object))
    return flat, codes.astype(np.int64), sizes, list(names)


def true_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]


def sha256_lower(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)
