"""Sketched distinct counts beside the exact ones, each with whether it is within the stated error."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import cities, sketches
from gleaner.session import ensure_checkpoint_dir
from gleaner.tables import Tables

#: Claims whose distinct ids one task keeps (at most about 0.8 KB each).
ROWS_PER_TASK = 1 << 19


def _beside(exact: DataFrame, sketched: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """The exact rows, and ``<count>_within`` of each count's estimate; a group without estimates fails."""
    named = sketched.select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.col(c).alias(f"_{c}") for c in counts))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return exact.join(named, same, "full").select(*keys, *counts, *(
        F.coalesce(sketches.within(f"_{c}", c), F.lit(False)).alias(f"{c}_within") for c in counts))


def city_counts_sketched(t: Tables) -> DataFrame:
    """B1 exactly and by sketches."""
    return _beside(cities.city_counts_left(t), sketches.city_counts_sketched(t), ["City"], ["Providers", "Receivers"])


def city_conditional_sketched(t: Tables) -> DataFrame:
    """A16 exactly and by sketches."""
    return _beside(cities.city_conditional_distinct(t), sketches.city_conditional_sketched(t), ["city"],
                   ["food_providers", "food_receivers"])


def monthly_reach_sketched(t: Tables) -> DataFrame:
    """Distinct receivers, listings and providers per city and month, exactly and from stored daily sketches.

    The sketches are loaded in two parts, open claims and then the others, as claims that come late are; their days
    are merged, compacted and rolled up to months.
    """
    spark = t.claims.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/gleaner-sketches-{uuid.uuid4().hex}"
    late = F.coalesce(F.col("Status") != "Pending", F.lit(True))
    for part in (~late, late):
        sketches.add_sketches(sketches.activity_sketches(
            Tables(t.providers, t.receivers, t.listings, t.claims.where(part))), f"{path}/loads")
    sketches.compact_sketches(spark, f"{path}/loads", f"{path}/days")
    # Distinct rows are first kept by task: the tasks' number grows with the claims, so what one keeps does not.
    ids = [*sketches.ACTIVITY.values()]
    active = sketches.claim_activity(t).select("City", F.trunc("Day", "month").alias("Period"), *ids)
    exact = (active.repartition(1 + t.claims.count() // ROWS_PER_TASK, *active.columns).groupBy("City", "Period")
             .agg(*(F.count_distinct(c).alias(n) for n, c in sketches.ACTIVITY.items())))
    return _beside(exact, sketches.reach(sketches.load_sketches(spark, f"{path}/days")), ["City", "Period"],
                   list(sketches.ACTIVITY))
