"""City-level metrics across providers, receivers, listings and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import order_desc
from gleaner.tables import Tables


def city_counts_left(t: Tables) -> DataFrame:
    """Distinct providers and receivers per provider city (providers LEFT JOIN receivers USING City).

    Each side is reduced to one row per city before the join, which replaces
    the providers x receivers fan-out of the literal query. Receiver-only
    cities are absent; a NULL city keeps its providers and 0 receivers.
    """
    p = t.providers.groupBy("City").agg(F.count_distinct("Provider_ID").alias("Providers"))
    r = (t.receivers.where(F.col("City").isNotNull()).groupBy("City")
         .agg(F.count_distinct("Receiver_ID").alias("Receivers")))
    return p.join(r, "City", "left").select(
        "City", "Providers", F.coalesce(F.col("Receivers"), F.lit(0)).alias("Receivers"))


def city_counts_union(t: Tables) -> DataFrame:
    """Every city of either side with its provider and receiver row counts.

    The reference's correlated subqueries compare a column with itself; this is
    the per-city count they were meant to give. One union and one grouped
    aggregate, no join. A NULL city is one of the cities and counts 0 / 0.
    """
    p = t.providers.select("City", F.lit(1).alias("p"), F.lit(0).alias("r"))
    r = t.receivers.select("City", F.lit(0).alias("p"), F.lit(1).alias("r"))
    g = p.unionByName(r).groupBy("City").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
    is_null = F.col("City").isNull()
    return g.select("City",
                    F.when(is_null, F.lit(0).cast("long")).otherwise(F.col("p")).alias("Provider_Count"),
                    F.when(is_null, F.lit(0).cast("long")).otherwise(F.col("r")).alias("Receiver_Count"))


def city_conditional_distinct(t: Tables) -> DataFrame:
    """Distinct typed providers and receivers per city from one combined table.

    Each side counts its distinct ids (two-level aggregate, skew-safe), then
    the per-city rows are combined by a union and a sum.
    """
    def side(df: DataFrame, key: str, mine: str, other: str) -> DataFrame:
        typed = F.when(F.col("Type").isNotNull(), F.col(key))
        return (df.groupBy(F.col("City").alias("city"))
                .agg(F.count_distinct(typed).alias(mine))
                .withColumn(other, F.lit(0).cast("long")))

    u = side(t.providers, "Provider_ID", "food_providers", "food_receivers").unionByName(
        side(t.receivers, "Receiver_ID", "food_receivers", "food_providers"))
    return u.groupBy("city").agg(F.sum("food_providers").alias("food_providers"),
                                 F.sum("food_receivers").alias("food_receivers"))


def city_flow(t: Tables) -> DataFrame:
    """Claims between provider city and receiver city.

    Listings meet providers first; claims join that once (by Food_ID) and are
    reduced to (Provider_City, Receiver_ID) counts before receivers are joined,
    so only the per-receiver rows travel to the last join.
    """
    food_city = t.listings.select("Food_ID", "Provider_ID").join(
        t.providers.select("Provider_ID", F.col("City").alias("Provider_City")), "Provider_ID")
    per = (t.claims.select("Food_ID", "Receiver_ID")
           .join(food_city.select("Food_ID", "Provider_City"), "Food_ID")
           .groupBy("Provider_City", "Receiver_ID").agg(F.count(F.lit(1)).alias("n")))
    g = (per.join(t.receivers.select("Receiver_ID", F.col("City").alias("Receiver_City")),
                  "Receiver_ID")
         .groupBy("Provider_City", "Receiver_City").agg(F.sum("n").alias("Total_Transactions")))
    return order_desc(g, "Total_Transactions", ["Provider_City", "Receiver_City"])
