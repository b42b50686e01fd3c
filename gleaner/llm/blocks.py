"""Comparing the rows of a bucket with each other in blocks of bounded size.

A bucket of more than ``block`` rows is cut into chunks by a hash of the rows'
ids, and each pair of chunks is a block of its own: no task holds more than two
chunks of a bucket, and every pair of its rows meets in one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.lineage import cut


def in_blocks(rows: DataFrame, keys: list[str], row_id: str, block: int) -> DataFrame:
    """Rows of buckets (equal ``keys``) with two rows or more, and chunk, low, high: once for each block they are in."""
    counts = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "buckets")
    return (rows.join(counts, keys).withColumn("_g", F.ceil(F.col("_n") / block).cast("int"))
            .withColumn("chunk", F.pmod(F.xxhash64(row_id), F.col("_g")).cast("int"))
            .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
            .withColumn("low", F.least("chunk", "_o")).withColumn("high", F.greatest("chunk", "_o"))
            .drop("_n", "_g", "_o"))


def by_block(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of a block in one partition, one after another."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (rows with equal ``keys`` stand together) and the groups' bounds in them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        bounds = _bounds(table, keys)
        last = int(bounds[-2])
        if last:  # the last group may go on in the next batch
            yield table.slice(0, last), bounds[:-1]
            held = table.slice(last).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, _bounds(table, keys)


def _bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        values = table.column(k).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)
