"""Bounded slices of Arrow batches, and small helpers all text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a vectorised step works on at once.
SLICE_BYTES = 1 << 20


def byte_sizes(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)


def slices(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes each; a longer row stands alone."""
    lo, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > lo and held + size > limit:
            yield lo, i
            lo, held = i, 0
        held += size
    if lo < len(sizes):
        yield lo, len(sizes)


def each_slice(
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], text: str = "text", limit: int = SLICE_BYTES
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function: ``make()`` builds, once a task, what turns a slice of rows into result rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for lo, hi in slices(byte_sizes(batch.column(text)), limit):
                yield work(batch.slice(lo, hi - lo))

    return run


def held_out(doc_id: Column, folds: int) -> Column:
    """True where the CRC-32 of the id, written as text, is divisible by ``folds``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that operators read, under fixed names; a null text becomes an empty one."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")
    )
