"""Inserts, updates and deletes applied as batch jobs over a table of changes.

A change row carries ``op`` (insert / update / delete), ``seq`` (order of the
statements), the table's columns and ``set_columns`` (the columns an update
sets; a listed column may be set to NULL). Semantics follow one statement at
a time in ``seq`` order, as the reference's forms did:

* insert adds a row (a duplicate key adds a second row: no key is enforced);
* update sets the listed columns on every row that has the key *at that time*;
* delete removes every row with the key; nothing cascades.

The fold is a grouped aggregate per key (partial aggregation, so one hot key
never lands whole in one task) and one join of the table with one row per
changed key; AQE broadcasts that side when its measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.numbering import DELETE, INSERT, number_keyless
from gleaner.session import cut, ensure_checkpoint_dir

UPDATE = "update"


def stamp_inserts(changes: DataFrame, column: str = "Timestamp") -> DataFrame:
    """Inserts without a time get the current local time (a claim is stamped when submitted)."""
    missing = (F.lower(F.trim("op")) == INSERT) & F.col(column).isNull()
    return changes.withColumn(column, F.when(missing, F.localtimestamp()).otherwise(F.col(column)))


def next_id_base(df: DataFrame, key: str) -> Column:
    """Highest key in the table, 0 when it is empty (the next id is this + 1)."""
    return df.agg(F.coalesce(F.max(key), F.lit(0)).cast("long")).scalar()


def assign_ids(new: DataFrame, key: str, base: Column, order_by: list[str] | None = None) -> DataFrame:
    """Give ``new`` rows consecutive ids ``base + 1, base + 2, ...``.

    Distributed: the rows are (optionally) range-sorted and checkpointed to the
    shared checkpoint folder, so partitions are fixed; each partition's offset
    is the number of rows before it, counted from one row per partition.
    """
    ensure_checkpoint_dir(new.sparkSession)
    staged = new
    if order_by:
        # The last sort key tells identical rows apart, so the range partitioner
        # can split a large group of copies instead of sending it to one task.
        staged = (new.withColumn("_tie", F.monotonically_increasing_id())
                  .orderBy(*order_by, "_tie").drop("_tie"))
    staged = staged.checkpoint(eager=True)
    pos = (staged.withColumn("_pid", F.spark_partition_id())
           .withColumn("_pos", F.monotonically_increasing_id()
                       - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: bounded by the partition count, so it can be broadcast.
    offsets = (pos.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
               .select("_pid", "_off"))
    out = pos.join(F.broadcast(offsets), "_pid")
    return (out.withColumn(key, base + F.col("_off") + F.col("_pos") + F.lit(1))
            .drop("_pid", "_pos", "_off"))


def append_rows(df: DataFrame, new: DataFrame, key: str, order_by: list[str] | None = None) -> DataFrame:
    """Insert rows; rows without a key get ``max(key) + 1, ...`` (1 on an empty table)."""
    new = new.select(*df.columns)
    keyed = new.where(F.col(key).isNotNull())
    keyless = new.where(F.col(key).isNull())
    return df.unionByName(keyed).unionByName(assign_ids(keyless, key, next_id_base(df, key), order_by)
                                             .select(*df.columns))


def apply_deletes(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Remove every row whose key is listed (anti join against the distinct keys)."""
    return df.join(keys.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def _fold(changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per changed key: last delete, and per column the last update that set it."""
    op, seq = F.col("op"), F.col("seq")
    aggs = [F.max(F.when(op == DELETE, seq)).alias("_del")]
    for c in columns:
        sets = (op == UPDATE) & F.coalesce(F.array_contains("set_columns", c), F.lit(False))
        at = F.when(sets, seq)
        aggs += [F.max(at).alias(f"_at_{c}"), F.max_by(F.col(f"`{c}`"), at).alias(f"_val_{c}")]
    return (changes.where(op.isin(UPDATE, DELETE) & F.col(key).isNotNull())
            .groupBy(key).agg(*aggs))


def apply_updates(df: DataFrame, updates: DataFrame, key: str,
                  updatable: list[str] | None = None) -> DataFrame:
    """Set the listed columns of every row with the key; later ``seq`` wins per column."""
    if "op" not in updates.columns:
        updates = updates.withColumn("op", F.lit(UPDATE))
    if "seq" not in updates.columns:
        updates = updates.withColumn("seq", F.lit(0).cast("long"))
    return apply_changes(df, updates.where(F.lower(F.trim("op")) == UPDATE), key, new_ids=False,
                         updatable=updatable)


def refuse_unordered_updates(changes: DataFrame, key: str) -> None:
    """ValueError if two updates of one key share a ``seq``."""
    same = changes.where((F.col("op") == UPDATE) & F.col(key).isNotNull()).groupBy(key, "seq").count()
    if same.where("count > 1").limit(1).count():
        raise ValueError("two updates of one key share a seq")


def apply_changes(df: DataFrame, changes: DataFrame, key: str, new_ids: bool = True,
                  updatable: list[str] | None = None) -> DataFrame:
    """The table after all changes, statement by statement in ``seq`` order.

    A row (existing, or inserted at seq ``s``) survives unless a delete of its
    key comes later; each column takes the value of the last update that set
    it after the row existed. Keyless inserts are numbered first
    (:func:`number_keyless`), so later updates and deletes reach the new rows.
    Two updates of one key with equal ``seq`` have no order: they are refused
    (ValueError). ``new_ids=False`` declares that the batch has neither keyless
    inserts nor such updates, which skips both. ``updatable`` names the only
    columns updates may set (others in ``set_columns`` are ignored); the fold
    then aggregates just those, e.g. as a hash aggregate for numeric columns.
    """
    columns = [c for c in df.columns if c != key]
    settable = [c for c in columns if updatable is None or c in updatable]
    changes = changes.withColumn("op", F.lower(F.trim("op")))
    if new_ids:
        changes = cut(changes, "changes")
        refuse_unordered_updates(changes, key)
    fold = _fold(changes, key, settable)  # updates and deletes: not touched by the numbering
    if new_ids:
        changes = number_keyless(df, changes, key)
    inserts = changes.where((F.col("op") == INSERT))
    rows = (df.withColumn("_seq", F.lit(None).cast("long"))
            .unionByName(inserts.where(F.col(key).isNotNull())
                         .select(*df.columns, F.col("seq").alias("_seq"))))
    j = rows.join(fold, key, "left")
    born = F.col("_seq")
    alive = F.col("_del").isNull() | (born.isNotNull() & (born > F.col("_del")))
    out = []
    for c in columns:
        if c not in settable:
            out.append(F.col(f"`{c}`"))
            continue
        at = F.col(f"_at_{c}")
        later = at.isNotNull() & (born.isNull() | (at > born))
        out.append(F.when(later, F.col(f"_val_{c}")).otherwise(F.col(f"`{c}`")).alias(c))
    survivors = j.where(alive)
    return survivors.select(F.col(key), *out).select(*df.columns)
