"""What the corpus operators share: slices of Arrow batches, word rules, the documents table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.tables import table

#: A word is a maximal run of anything but ASCII white space. Python's bytes.split() splits at the same bytes.
SPACE = r"[\x20\x09-\x0D]+"
#: Text bytes that a Python worker handles at once; a longer text makes a slice of its own.
SLICE_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def row_key(columns: list[str]) -> Column:
    """128 bits that tell rows apart by all of these columns; a null is told from what stands in another column."""
    parts = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return F.unhex(F.concat(*(F.lpad(F.hex(F.xxhash64(*seed, *parts)), 16, "0") for seed in ((), (F.lit(1),)))))


def words(text: str | Column) -> Column:
    """The words of a text; none for null or blank."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in pieces of about `budget` bytes of the column: bounded memory whatever the batch."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + budget, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column joined, and the n + 1 offsets of the rows. A null is an empty text."""
    texts = pc.fill_null(batch.column(column).cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]
