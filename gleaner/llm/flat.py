"""Helpers for operators that look at the bytes of a batch of texts at once.

A batch of strings is seen as one flat ``uint8`` array and the offsets of its
texts, so class counts and word counts are numpy passes over bytes. UTF-8 keeps
ASCII bytes unique, so classes of ASCII characters can be counted on bytes.
Batches are cut into slices of a few MB, which bounds the temporary arrays
whatever the texts' lengths (one text is never cut).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SLICE_BYTES = 2 << 20


def byte_table(codes) -> np.ndarray:
    """256 flags: True at the given byte values."""
    table = np.zeros(256, dtype=bool)
    table[list(codes)] = True
    return table


#: Bytes of a word ``[^\x20\x09-\x0D]+``: everything but six ASCII white-space bytes.
BLANK = (0x20, *range(0x09, 0x0E))
IN_WORD = ~byte_table(BLANK)


def flat_utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, where, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(where, dtype=np.int64, count=n + 1, offset=8 * column.offset)
    if data is None or n == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    return np.frombuffer(data, dtype=np.uint8, count=last - first, offset=first), offsets - first


def slices(batches: Iterator[pa.RecordBatch], column: str,
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in slices of at most ``limit`` bytes of ``column`` or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            base = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def starts_of(inside: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Flags the first byte of each maximal run of ``inside`` within a text."""
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = inside[first]
    return starts


def count_per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    return np.fromiter((np.count_nonzero(flags[a:b]) for a, b in zip(offsets[:-1], offsets[1:])),
                       dtype=np.int64, count=len(offsets) - 1)


def words_per_text(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray = IN_WORD) -> np.ndarray:
    """Number of maximal runs of word bytes in each text."""
    return count_per_text(starts_of(table[buf], offsets), offsets)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it, so that ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def add_columns(df: DataFrame, text_col: str, ddl: str,
                compute: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """``df`` and the columns of ``ddl``, which ``compute`` makes of a slice of texts."""
    added = StructType.fromDDL(ddl)
    names = df.columns + added.names
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([*batch.columns, *compute(batch.column(at))], names=names)

    return df.mapInArrow(run, StructType(df.schema.fields + added.fields))
