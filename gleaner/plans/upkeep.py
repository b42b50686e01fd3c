"""Table upkeep jobs: the change operators applied to changes derived from the tables.

* ``claims_renumbered``: every claim re-inserted through the keyless insert
  path in time order, so ids become 1..n and duplicate Claim_IDs disappear.
* ``listings_without_expired``: delete every listing that expired before ``as_of``.
* ``listings_quantity_settled``: set each claimed listing's Quantity to its
  quantity minus its completed claims (the per-listing form of the wasted
  quantity metric).
* ``claims_reissued``: every cancelled claim entered again without an id, so new
  ids go on from the table's highest.
* ``claims_withdrawn``: the same, but every second of them is withdrawn at once, by a
  delete of the id that it has just got, before the next is entered: ids are given
  again, so the next entry's depends on every delete before it.
* ``claims_of_expired``: claims whose listing is gone once the expired ones are
  deleted (the dangling references that a delete leaves).
* ``claims_via_store``: the claims after a full-replace load into a folder of their
  own and a typed read-back.
* ``listings_after_changes``: both as one change batch (deletes at seq 1,
  updates at seq 2), folded by :func:`apply_changes`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.dates import as_of_date
from gleaner.operators.changes import (
    DELETE,
    INSERT,
    UPDATE,
    apply_changes,
    apply_deletes,
    apply_updates,
    assign_ids,
    next_id_base,
)
from gleaner.operators.quality import orphans
from gleaner.schema import CANCELLED, COMPLETED, PENDING
from gleaner.session import ensure_checkpoint_dir
from gleaner.sources.store import load_table, save_table
from gleaner.tables import Tables

CLAIM_ORDER = ["Timestamp", "Food_ID", "Receiver_ID", "Status", "_old_id"]


def claims_renumbered(t: Tables) -> DataFrame:
    """Claims with ids 1..n in (Timestamp, Food_ID, Receiver_ID, Status, old id) order."""
    staged = t.claims.withColumn("_old_id", F.col("Claim_ID"))
    out = assign_ids(staged, "Claim_ID", F.lit(0).cast("long"), CLAIM_ORDER)
    return out.select(*t.claims.columns)


def claims_reissued(t: Tables) -> DataFrame:
    """All claims, and the cancelled ones once more as pending, numbered on from the highest id."""
    again = (t.claims.where(F.col("Status") == F.lit(CANCELLED)).withColumn("_old_id", F.col("Claim_ID"))
             .withColumn("Claim_ID", F.lit(None).cast("long")))
    numbered = assign_ids(again, "Claim_ID", next_id_base(t.claims, "Claim_ID"), CLAIM_ORDER)
    return t.claims.unionByName(numbered.withColumn("Status", F.lit(PENDING)).select(*t.claims.columns))


def claims_withdrawn(t: Tables) -> DataFrame:
    """All claims, and the cancelled ones once more as pending, of which every second is withdrawn as soon as entered.

    One batch of keyless inserts and deletes between them. The k-th pair of entries gets the ids ``top + k`` and
    ``top + k + 1``, and the second of them is free again for the next pair; ``top`` is the table's highest id.
    """
    schema = t.claims.schema
    again = t.claims.where(F.col("Status") == F.lit(CANCELLED)).withColumn("_old_id", F.col("Claim_ID"))
    entries = assign_ids(again.drop("Claim_ID"), "_nth", F.lit(0).cast("long"), CLAIM_ORDER)
    top = next_id_base(t.claims, "Claim_ID")
    none = F.lit(None)
    entered = entries.select(
        F.lit(INSERT).alias("op"), (2 * F.col("_nth")).alias("seq"), none.cast("long").alias("Claim_ID"), "Food_ID",
        "Receiver_ID", F.lit(PENDING).alias("Status"), "Timestamp")
    withdrawn = entries.where(F.col("_nth") % 2 == 0).select(
        F.lit(DELETE).alias("op"), (2 * F.col("_nth") + 1).alias("seq"), (top + F.col("_nth") / 2 + 1).cast("long").alias(
            "Claim_ID"), *(none.cast(schema[c].dataType).alias(c) for c in schema.names[1:]))
    changes = entered.unionByName(withdrawn).withColumn("set_columns", none.cast("array<string>"))
    return apply_changes(t.claims, changes, "Claim_ID", updatable=[])


def claims_of_expired(t: Tables, as_of=None) -> DataFrame:
    return orphans(t.claims, listings_without_expired(t, as_of), "Food_ID").select(*t.claims.columns)


def claims_via_store(t: Tables) -> DataFrame:
    spark = t.claims.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/gleaner-claims-{uuid.uuid4().hex}"
    save_table(t.claims, path, "claims")
    return load_table(spark, path, "claims")


def expired_keys(t: Tables, as_of) -> DataFrame:
    return t.listings.where(F.col("Expiry_Date") < as_of_date(as_of)).select("Food_ID").distinct()


def listings_without_expired(t: Tables, as_of=None) -> DataFrame:
    return apply_deletes(t.listings, expired_keys(t, as_of), "Food_ID")


def settle_updates(t: Tables, seq: int) -> DataFrame:
    """One update per claimed listing key: Quantity := min(Quantity) - completed claims."""
    done = (t.claims.where(F.col("Status") == F.lit(COMPLETED))
            .groupBy("Food_ID").agg(F.count("Claim_ID").alias("_done")))
    per_key = t.listings.groupBy("Food_ID").agg(F.min("Quantity").alias("_q"))
    upd = per_key.join(done, "Food_ID")
    cols = {c: F.lit(None).cast(t.listings.schema[c].dataType) for c in t.listings.columns}
    cols["Food_ID"] = F.col("Food_ID")
    cols["Quantity"] = F.col("_q") - F.col("_done")
    return upd.select(F.lit(UPDATE).alias("op"), F.lit(seq).cast("long").alias("seq"),
                      *[v.alias(k) for k, v in cols.items()],
                      F.array(F.lit("Quantity")).alias("set_columns"))


def listings_quantity_settled(t: Tables) -> DataFrame:
    return apply_updates(t.listings, settle_updates(t, 1), "Food_ID", updatable=["Quantity"])


def change_rows(keys: DataFrame, schema: T.StructType, key: str, op: str, seq: int,
                sets: dict[str, Column] | None = None) -> DataFrame:
    """A change row of each key: a delete, or an update that sets the columns of ``sets``."""
    sets = sets or {}
    cells = [F.col(f.name) if f.name == key else sets.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    names = F.array(*map(F.lit, sets)) if sets else F.lit(None)
    return keys.select(F.lit(op).alias("op"), F.lit(seq).cast("long").alias("seq"), *cells,
                       names.cast("array<string>").alias("set_columns"))


def listings_after_changes(t: Tables, as_of=None) -> DataFrame:
    deletes = change_rows(expired_keys(t, as_of), t.listings.schema, "Food_ID", DELETE, 1)
    return apply_changes(t.listings, deletes.unionByName(settle_updates(t, 2)), "Food_ID",
                         new_ids=False, updatable=["Quantity"])
