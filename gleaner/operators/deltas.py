"""Aggregates kept up to date under changes: signed deltas merged into stored state.

A change batch turns some rows into others. Each old row counts -1 and each new
row +1, equal rows cancel, and what is left is a **delta**: it has the size of the
batch, not of the table. Every aggregate here is a sum over rows, so its state
takes a delta by adding the delta's own aggregate to the groups concerned:

* counts, sums and averages: rows, non-NULL values and their sum per group;
* distinct counts: how many rows hold each (group, value); a value counts while
  any does, so deletes take it out when its last row goes;
* extremes: the same multiset, read through ``max`` and ``min``;
* shares: counts over their total, on read;
* the wasted quantity, which joins listings with claims: one state row per
  Food_ID, whose contribution to its location is retracted and added anew.

State is a versioned table (``gleaner.sources.versions``), keyed by group, so a
batch reads and rewrites the buckets of the groups it changes.

Defined cases: NULL keys are groups; a group that loses its last row leaves the
state; a sum over no non-NULL value is NULL, as ``SUM`` has it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.schema import COMPLETED

SIGN = "_sign"


def signed(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` that ``old`` has not, with sign 1 and up, and those it lost, with -1 and down.

    A row and its copies are one row with their number as sign. Partial aggregation cancels rows before the shuffle
    where both sides are in one task, and a row that a third of both tables repeat is one row a task.
    """
    both = old.withColumn(SIGN, F.lit(-1)).unionByName(new.withColumn(SIGN, F.lit(1)))
    return both.groupBy(*new.columns).agg(F.sum(SIGN).cast("long").alias(SIGN)).where(F.col(SIGN) != 0)


# Counts, sums, averages ------------------------------------------------------------------------


@dataclass(frozen=True)
class Sums:
    """Rows per group, and of each of ``values`` how many are not NULL and their sum."""

    keys: tuple[str, ...]
    values: tuple[str, ...] = ()

    def state(self, rows: DataFrame) -> DataFrame:
        """The state of whole rows, or the delta's of signed ones."""
        sign = F.col(SIGN) if SIGN in rows.columns else F.lit(1)
        aggs = [F.sum(sign).cast("long").alias("rows")]
        for v in self.values:
            aggs += [F.coalesce(F.sum(F.when(F.col(v).isNotNull(), sign)), F.lit(0)).cast("long").alias(f"n_{v}"),
                     F.coalesce(F.sum(sign * F.col(v)), F.lit(0)).cast("long").alias(f"sum_{v}")]
        return rows.groupBy(*self.keys).agg(*aggs)

    def merge(self, state: DataFrame, delta: DataFrame) -> DataFrame:
        """The state after a delta's state is added; groups without rows are gone."""
        names = [c for c in state.columns if c not in self.keys]
        both = state.unionByName(delta)
        return both.groupBy(*self.keys).agg(*(F.sum(n).alias(n) for n in names)).where(F.col("rows") != 0)

    def total(self, value: str) -> Column:
        return F.when(F.col(f"n_{value}") > 0, F.col(f"sum_{value}"))

    def mean(self, value: str) -> Column:
        return F.try_divide(F.col(f"sum_{value}").cast("double"), F.col(f"n_{value}"))


# Distinct counts and extremes --------------------------------------------------------------------


@dataclass(frozen=True)
class Holders:
    """How many rows of each group hold each value."""

    keys: tuple[str, ...]
    value: str

    @property
    def counted(self) -> Sums:
        return Sums((*self.keys, self.value))

    def state(self, rows: DataFrame) -> DataFrame:
        return self.counted.state(rows)

    def merge(self, state: DataFrame, delta: DataFrame) -> DataFrame:
        return self.counted.merge(state, delta)

    def distinct(self, state: DataFrame, alias: str) -> DataFrame:
        """``COUNT(DISTINCT value)`` per group; the state holds each value once, so it is a plain count."""
        return state.groupBy(*self.keys).agg(F.count(self.value).alias(alias))

    def highest(self, state: DataFrame, alias: str) -> DataFrame:
        return state.groupBy(*self.keys).agg(F.max(self.value).alias(alias))

    def lowest(self, state: DataFrame, alias: str) -> DataFrame:
        return state.groupBy(*self.keys).agg(F.min(self.value).alias(alias))


# Wasted quantity ---------------------------------------------------------------------------------

FOOD_STATE = ["Food_ID", "Location", "Quantity", "listed", "done"]


def done_per_food(claims: DataFrame) -> DataFrame:
    """(Food_ID, done): completed claims with an id per listing id, of whole or signed rows."""
    sign = F.col(SIGN) if SIGN in claims.columns else F.lit(1)
    return (claims.where((F.col("Status") == COMPLETED) & F.col("Food_ID").isNotNull()).groupBy("Food_ID")
            .agg(F.coalesce(F.sum(F.when(F.col("Claim_ID").isNotNull(), sign)), F.lit(0)).cast("long").alias("done")))


def _listed(listings: DataFrame) -> DataFrame:
    return listings.groupBy("Food_ID").agg(F.min("Location").alias("Location"), F.min("Quantity").alias("Quantity"),
                                           F.count(F.lit(1)).alias("listed"))


def food_state(listings: DataFrame, claims: DataFrame) -> DataFrame:
    """One row per listing id: where it is listed, how much, in how many rows, and its completed claims.

    Ids that only claims have are kept with 0 rows, for a listing may come later.
    """
    return _food_rows(_listed(listings), done_per_food(claims))


def _food_rows(listed: DataFrame, done: DataFrame) -> DataFrame:
    same = F.col("l.Food_ID").eqNullSafe(F.col("d.Food_ID"))
    return listed.alias("l").join(done.alias("d"), same, "full").select(
        F.coalesce("l.Food_ID", "d.Food_ID").alias("Food_ID"), "l.Location", "l.Quantity",
        F.coalesce("l.listed", F.lit(0).cast("long")).alias("listed"),
        F.coalesce("d.done", F.lit(0).cast("long")).alias("done")).where("listed > 0 OR done != 0")


def food_after(state: DataFrame, delta: DataFrame) -> DataFrame:
    """State rows of the buckets concerned after a ``food_delta``: relisted ids get the new listing, all their claims."""
    s, d = state.alias("s"), delta.alias("d")
    moved = F.coalesce(F.col("d.relisted"), F.lit(False))

    def now(c: str) -> Column:
        return F.when(moved, F.col(f"d.{c}")).otherwise(F.col(f"s.{c}")).alias(c)

    return (s.join(d, F.col("s.Food_ID").eqNullSafe(F.col("d.Food_ID")), "full")
            .select(F.coalesce("s.Food_ID", "d.Food_ID").alias("Food_ID"), now("Location"), now("Quantity"),
                    F.coalesce(now("listed"), F.lit(0).cast("long")).alias("listed"),
                    (F.coalesce("s.done", F.lit(0)) + F.coalesce("d.done", F.lit(0))).cast("long").alias("done"))
            .where("listed > 0 OR done != 0"))


def food_delta(old_listings: DataFrame, new_listings: DataFrame, signed_claims: DataFrame) -> DataFrame:
    """(Food_ID, relisted, Location, Quantity, listed, done): ids whose listing rows changed, as they are now, and the
    change of each id's completed claims. The listings are those of the buckets that a batch rewrote."""
    changed = signed(old_listings, new_listings).select("Food_ID").distinct()
    j = changed.withColumn("relisted", F.lit(True)).alias("t").join(
        _listed(new_listings).alias("l"), F.col("t.Food_ID").eqNullSafe(F.col("l.Food_ID")), "left").select(
        "t.Food_ID", "t.relisted", "l.Location", "l.Quantity",
        F.coalesce("l.listed", F.lit(0).cast("long")).alias("listed"))
    done = done_per_food(signed_claims).where("done != 0")
    return j.alias("j").join(done.alias("c"), F.col("j.Food_ID").eqNullSafe(F.col("c.Food_ID")), "full").select(
        F.coalesce("j.Food_ID", "c.Food_ID").alias("Food_ID"), F.coalesce("j.relisted", F.lit(False)).alias("relisted"),
        "j.Location", "j.Quantity", F.coalesce("j.listed", F.lit(0).cast("long")).alias("listed"),
        F.coalesce("c.done", F.lit(0).cast("long")).alias("done"))


WASTED = Sums(("Location",), ("Quantity", "claimed"))


def contributions(state: DataFrame) -> DataFrame:
    """What each listed id adds to its location: its quantity and the completed claims of each of its rows."""
    sign = [SIGN] if SIGN in state.columns else []
    return state.where("listed > 0").select("Location", "Quantity", (F.col("listed") * F.col("done")).alias("claimed"), *sign)


def wasted(state: DataFrame) -> DataFrame:
    """S15 from its state per location."""
    return state.select("Location", (WASTED.total("Quantity") - F.col("sum_claimed")).alias("Wasted_Quantity"))
