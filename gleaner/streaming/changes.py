"""Apply a stream of change files to a table, one snapshot per micro-batch.

The reference edits its tables one form submit at a time. Here change rows
land as parquet files in a folder; Structured Streaming picks them up and each
micro-batch folds its changes into the previous snapshot
(:func:`gleaner.operators.changes.apply_changes`) and writes the next one:

    root/v=0000000000   initial table
    root/v=<batch + 1>  table after micro-batch <batch>

Micro-batch ``b`` reads ``v=b`` and overwrites ``v=b+1``; a retried batch
writes the same version again, so a lost executor or a restart from the
checkpoint cannot apply a change twice.

:func:`start_versioned` folds them into a versioned table instead: a micro-batch
rewrites the buckets of its keys only, and is published with its number, so a
retried batch is found to be there. Other writers may commit between batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators.changes import apply_changes
from gleaner.schema import KEYS, SCHEMAS, change_schema
from gleaner.session import ensure_checkpoint_dir
from gleaner.sources.versions import VersionedTable


def snapshot_path(root: str, version: int) -> str:
    return f"{root}/v={version:010d}"


def write_initial(df: DataFrame, root: str) -> None:
    df.write.mode("overwrite").parquet(snapshot_path(root, 0))


def read_snapshot(spark: SparkSession, root: str, table: str, version: int) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(snapshot_path(root, version))


def start(spark: SparkSession, table: str, changes_dir: str, root: str,
          checkpoint_location: str | None = None, trigger: dict | None = None,
          max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the change stream for ``table``; returns the running query.

    ``max_files_per_trigger`` bounds a micro-batch, so a backlog of change
    files is folded in several snapshots instead of one oversized batch.
    """
    key = KEYS[table]
    name = hashlib.sha1(root.encode()).hexdigest()[:10]  # each stream has a folder of its own
    location = checkpoint_location or f"{ensure_checkpoint_dir(spark)}/changes-{table}-{name}"

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        current = read_snapshot(spark, root, table, batch_id)
        nxt = apply_changes(current, batch, key)
        nxt.write.mode("overwrite").parquet(snapshot_path(root, batch_id + 1))

    return _start(spark, table, changes_dir, apply_batch, location, trigger, max_files_per_trigger)


def start_versioned(spark: SparkSession, table: str, changes_dir: str, store: VersionedTable,
                    checkpoint_location: str | None = None, trigger: dict | None = None,
                    max_files_per_trigger: int | None = None, keep: int | None = None) -> StreamingQuery:
    """Start the change stream for a versioned table; ``keep`` versions are retained (all by default)."""
    name = hashlib.sha1(store.root.encode()).hexdigest()[:10]
    location = checkpoint_location or f"{ensure_checkpoint_dir(spark)}/commits-{table}-{name}"

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        store.apply(batch, transaction=(location, batch_id))
        if keep:
            store.expire(keep)

    return _start(spark, table, changes_dir, apply_batch, location, trigger, max_files_per_trigger)


def _start(spark: SparkSession, table: str, changes_dir: str, apply_batch: Callable[[DataFrame, int], None],
           location: str, trigger: dict | None, max_files: int | None) -> StreamingQuery:
    reader = spark.readStream.schema(change_schema(table))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    writer = reader.parquet(changes_dir).writeStream.foreachBatch(apply_batch).option("checkpointLocation", location)
    return (writer.trigger(**trigger) if trigger else writer).start()
