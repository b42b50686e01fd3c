"""Approximate distinct counts: HyperLogLog sketches kept per city and day, merged and estimated on read.

Exact counts stay the default everywhere. The opt-in keeps one sketch per group
instead of its ids, so distinct counts of any coarser group (a month, a country,
all cities) and of any later load come from merging sketches: the rows are not
read again and no id is shuffled twice. A sketch of ``2 ** lg_k`` registers has
a relative standard error of about ``1.04 / sqrt(2 ** lg_k)``; small groups are
all but exact, since a sketch lists its first ids' hashes themselves.

Sketches take no retractions: after deletes the groups concerned are sketched
anew (``replace_days``).

Defined cases: NULL ids are not counted, as in ``COUNT(DISTINCT ...)``; a NULL city
or day is a group; a group whose ids are all NULL has the count 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.tables import Tables

LG_K = 12
#: Standard errors that an estimate of the registered queries may be off.
SIGMAS = 5


def standard_error(lg_k: int = LG_K) -> float:
    """Relative standard error of an estimate from merged sketches."""
    return 1.04 / 2 ** (lg_k / 2)


def within(estimate: str, exact: str, lg_k: int = LG_K, sigmas: float = SIGMAS) -> Column:
    """Whether the estimate is within ``sigmas`` standard errors of the exact count (half an id at least)."""
    return F.abs(F.col(estimate) - F.col(exact)) <= F.greatest(
        F.lit(0.5), F.lit(sigmas * standard_error(lg_k)) * F.col(exact))


def sketch_by(df: DataFrame, keys: list[str], ids: dict[str, str], lg_k: int = LG_K) -> DataFrame:
    """One sketch per group and id column: ``ids`` maps the sketch's name to the column.

    Partial sketches are built before the shuffle, so a group with a third of all rows is one sketch a task.
    """
    return df.groupBy(*keys).agg(*(F.hll_sketch_agg(c, lg_k).alias(name) for name, c in ids.items()))


def merge_by(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of coarser groups: the union of those of their parts."""
    names = [f.name for f in sketches.schema if isinstance(f.dataType, T.BinaryType)]
    return sketches.groupBy(*keys).agg(*(F.hll_union_agg(n).alias(n) for n in names))


def estimates(sketches: DataFrame) -> DataFrame:
    """Sketches replaced by their estimates, as whole numbers; a missing sketch counts 0."""
    return sketches.select(*(
        F.coalesce(F.hll_sketch_estimate(f.name), F.lit(0)).cast("long").alias(f.name)
        if isinstance(f.dataType, T.BinaryType) else F.col(f"`{f.name}`") for f in sketches.schema))


# Stored sketches of claim activity -------------------------------------------------------------


def claim_activity(t: Tables) -> DataFrame:
    """(City, Day, Receiver_ID, Food_ID, Provider_ID) of every claim with its listing.

    Listings carry their location and provider, so claims are shuffled once, by Food_ID; listings that share an id
    count for each.
    """
    listed = t.listings.select("Food_ID", F.col("Location").alias("City"), "Provider_ID")
    claimed = t.claims.select("Food_ID", "Receiver_ID", F.to_date("Timestamp").alias("Day"))
    return claimed.join(listed, "Food_ID")


ACTIVITY = {"receivers": "Receiver_ID", "listings": "Food_ID", "providers": "Provider_ID"}


def activity_sketches(t: Tables, lg_k: int = LG_K) -> DataFrame:
    """(City, Day, receivers, listings, providers): who was active in each city on each day, as sketches."""
    return sketch_by(claim_activity(t), ["City", "Day"], ACTIVITY, lg_k)


def add_sketches(new: DataFrame, path: str) -> None:
    """Append the sketches of a load; a (city, day) may come in any number of loads (late claims)."""
    new.write.mode("append").parquet(path)


def load_sketches(spark: SparkSession, path: str) -> DataFrame:
    """One row per (city, day) over all loads."""
    return merge_by(spark.read.parquet(path), ["City", "Day"])


def compact_sketches(spark: SparkSession, path: str, new_path: str) -> None:
    """All loads as one row per (city, day), sorted by day so that day predicates skip files."""
    load_sketches(spark, path).repartitionByRange("Day", "City").sortWithinPartitions("Day", "City").write.parquet(new_path)


def replace_days(spark: SparkSession, path: str, new_path: str, days: DataFrame, fresh: DataFrame) -> None:
    """The stored sketches with those of ``days`` (Day) replaced by ``fresh`` (after deletes)."""
    kept = spark.read.parquet(path).join(F.broadcast(days.select("Day").distinct()), "Day", "left_anti")
    kept.unionByName(fresh).write.parquet(new_path)


def reach(sketches: DataFrame, unit: str = "month") -> DataFrame:
    """Estimated distinct receivers, listings and providers per city and calendar unit, from stored sketches."""
    return estimates(merge_by(sketches.withColumn("Period", F.trunc("Day", unit)), ["City", "Period"]))


# City counts ---------------------------------------------------------------------------------


def city_counts_sketched(t: Tables, lg_k: int = LG_K) -> DataFrame:
    """``city_counts_left`` by sketches: providers and receivers per provider city."""
    p = estimates(sketch_by(t.providers, ["City"], {"Providers": "Provider_ID"}, lg_k))
    r = estimates(sketch_by(t.receivers.where(F.col("City").isNotNull()), ["City"], {"Receivers": "Receiver_ID"}, lg_k))
    return p.join(r, "City", "left").select("City", "Providers", F.coalesce("Receivers", F.lit(0)).alias("Receivers"))


def city_conditional_sketched(t: Tables, lg_k: int = LG_K) -> DataFrame:
    """``city_conditional_distinct`` by sketches: both sides' sketches in one union, merged per city."""
    def side(df: DataFrame, key: str, name: str) -> DataFrame:
        typed = df.select(F.col("City").alias("city"), F.when(F.col("Type").isNotNull(), F.col(key)).alias("id"))
        return sketch_by(typed, ["city"], {name: "id"}, lg_k)

    both = side(t.providers, "Provider_ID", "food_providers").unionByName(
        side(t.receivers, "Receiver_ID", "food_receivers"), allowMissingColumns=True)
    return estimates(merge_by(both, ["city"]))
