"""Change batches through versioned tables, and aggregates kept up to date by signed deltas.

* ``listings_after_commits``: the listings as a versioned table after two batches, the
  expired ones deleted and then quantities settled.
* ``listings_row_counts``: rows of each of its versions, from their entries.
* ``claims_of_two_writers``: two writers append from the same version; the second
  finds its number taken and numbers its claims anew.
* ``quantity_kept_by_location``, ``reach_kept_by_status``, ``wasted_kept_by_location``:
  sums and means, distinct counts and extremes, and the wasted quantity, from stored
  state after a batch on listings and one on claims; the tables are read once, to
  make the state before the batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import deltas
from gleaner.operators.changes import DELETE, INSERT, UPDATE, assign_ids
from gleaner.plans.upkeep import CLAIM_ORDER, change_rows, expired_keys, settle_updates
from gleaner.schema import CANCELLED, COMPLETED, PENDING
from gleaner.session import cut, ensure_checkpoint_dir
from gleaner.sources.versions import VersionedTable
from gleaner.tables import Tables

BUCKETS = 16


def _folder(df: DataFrame, name: str) -> str:
    return f"{ensure_checkpoint_dir(df.sparkSession)}/gleaner-{name}-{uuid.uuid4().hex}"


def _stored(df: DataFrame, name: str, keys, buckets: int = BUCKETS) -> VersionedTable:
    return VersionedTable.create(df, _folder(df, name), keys, buckets)


def _listing_batches(t: Tables, as_of) -> list[DataFrame]:
    gone = change_rows(expired_keys(t, as_of), t.listings.schema, "Food_ID", DELETE, 1)
    return [gone, settle_updates(t, 2)]


def _committed(t: Tables, as_of) -> VersionedTable:
    table = _stored(t.listings, "listings", "Food_ID")
    for k, batch in enumerate(_listing_batches(t, as_of)):
        table.apply(batch, transaction=("settle", k))
    return table


def listings_after_commits(t: Tables, as_of=None) -> DataFrame:
    return _committed(t, as_of).read()


def listings_row_counts(t: Tables, as_of=None) -> DataFrame:
    """(version, row_count) of the versions that the two batches make."""
    table = _committed(t, as_of)
    counts = [(n, table.row_count(n)) for n in table.numbers()]
    return t.listings.sparkSession.createDataFrame(counts, "version long, row_count long")


def claims_of_two_writers(t: Tables) -> DataFrame:
    """All claims, and the cancelled ones again as pending: odd ones by the first writer, even ones by the second."""
    again = t.claims.where(F.col("Status") == CANCELLED).withColumn("_old_id", F.col("Claim_ID")).drop("Claim_ID")
    entries = assign_ids(again, "_nth", F.lit(0).cast("long"), CLAIM_ORDER)
    none = F.lit(None)
    rows = entries.select(
        F.lit(INSERT).alias("op"), F.col("_nth").alias("seq"), none.cast("long").alias("Claim_ID"), "Food_ID",
        "Receiver_ID", F.lit(PENDING).alias("Status"), "Timestamp", none.cast("array<string>").alias("set_columns"))
    table = _stored(t.claims, "claims", "Claim_ID")
    odd = F.col("seq") % 2 == 1
    # The first writer's version appears when the second has written its files and not yet published them.
    table.apply(rows.where(~odd), before_publishing=lambda: table.apply(rows.where(odd)))
    return table.read()


def _claim_batch(t: Tables) -> DataFrame:
    """Cancelled claims are deleted, pending ones completed."""
    keys = t.claims.select("Claim_ID", "Status").where("Claim_ID IS NOT NULL")
    schema = t.claims.schema
    gone = change_rows(keys.where(F.col("Status") == CANCELLED).select("Claim_ID").distinct(), schema, "Claim_ID", DELETE, 1)
    done = change_rows(keys.where(F.col("Status") == PENDING).select("Claim_ID").distinct(), schema, "Claim_ID", UPDATE, 2,
                       {"Status": F.lit(COMPLETED)})
    return gone.unionByName(done)


def quantity_kept_by_location(t: Tables, as_of=None) -> DataFrame:
    """(Location, listings, total_quantity, avg_quantity) after the listings' batches."""
    spec = deltas.Sums(("Location",), ("Quantity",))
    listings = _stored(t.listings, "listings", "Food_ID")
    kept = _stored(spec.state(t.listings), "quantity", "Location")
    for batch in _listing_batches(t, as_of):
        old = listings.version().number
        new = listings.apply(batch).number
        kept.merge(spec.state(deltas.signed(*listings.differing(old, new))), spec.merge, transaction=("batch", new))
    return kept.read().select("Location", F.col("rows").alias("listings"), spec.total("Quantity").alias("total_quantity"),
                              spec.mean("Quantity").alias("avg_quantity"))


def reach_kept_by_status(t: Tables) -> DataFrame:
    """(Status, receivers, last_claim) after the claims' batch: a distinct count and a maximum that take deletes."""
    who, last = deltas.Holders(("Status",), "Receiver_ID"), deltas.Holders(("Status",), "Claim_ID")
    claims = _stored(t.claims, "claims", "Claim_ID")
    kept = {h: _stored(h.state(t.claims), "holders", ["Status", h.value]) for h in (who, last)}
    claims.apply(_claim_batch(t))
    held = ("Status", who.value, last.value)  # both states read the delta, which is taken once, of their columns
    delta = cut(deltas.signed(*(rows.select(*held) for rows in claims.differing(0, 1))), "delta")
    for h, table in kept.items():
        table.merge(h.state(delta), h.merge)
    a, b = who.distinct(kept[who].read(), "receivers"), last.highest(kept[last].read(), "last_claim")
    return a.alias("a").join(b.alias("b"), F.col("a.Status").eqNullSafe(F.col("b.Status"))).select(
        "a.Status", "a.receivers", "b.last_claim")


def wasted_kept_by_location(t: Tables, as_of=None) -> DataFrame:
    """S15 after the listings' deletes and the claims' batch, from state per Food_ID and per location."""
    listings, claims = _stored(t.listings, "listings", "Food_ID"), _stored(t.claims, "claims", "Claim_ID")
    foods = _stored(deltas.food_state(t.listings, t.claims), "foods", "Food_ID")
    kept = _stored(deltas.WASTED.state(deltas.contributions(foods.read())), "wasted", "Location")
    listings.apply(_listing_batches(t, as_of)[0])
    claims.apply(_claim_batch(t))
    change = deltas.food_delta(*listings.differing(0, 1), deltas.signed(*claims.differing(0, 1)))
    foods.merge(change, deltas.food_after)
    moved = deltas.signed(*foods.differing(0, 1))
    kept.merge(deltas.WASTED.state(deltas.contributions(moved)), deltas.WASTED.merge)
    return deltas.wasted(kept.read())
