"""Metrics over food listings alone (supply side)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import count_by, count_rows, order_desc, share_of_total, topk
from gleaner.functions.dates import as_of_date
from gleaner.tables import Tables


def total_quantity(t: Tables) -> DataFrame:
    return t.listings.agg(F.sum("Quantity").alias("total_quantity"))


def avg_quantity(t: Tables) -> DataFrame:
    return t.listings.agg(F.avg("Quantity").alias("avg_quantity"))


def listings_by_food_type(t: Tables) -> DataFrame:
    return order_desc(count_by(t.listings, "Food_Type", "Count"), "Count", ["Food_Type"])


def listings_by_meal_type(t: Tables) -> DataFrame:
    return count_by(t.listings, "Meal_Type", "Count")


def listings_by_provider_type(t: Tables) -> DataFrame:
    return count_by(t.listings, "Provider_Type", "num_listings")


def avg_quantity_by_provider_type(t: Tables) -> DataFrame:
    return t.listings.groupBy("Provider_Type").agg(F.avg("Quantity").alias("avg_quantity"))


def quantity_by_location(t: Tables) -> DataFrame:
    return t.listings.groupBy("Location").agg(F.sum("Quantity").alias("total_quantity"))


def expiring_within(t: Tables, as_of=None, days: int = 3) -> DataFrame:
    """Listings whose expiry is on or before ``as_of + days``; expired ones included."""
    return t.listings.where(F.col("Expiry_Date") <= F.date_add(as_of_date(as_of), days))


def expired_listings(t: Tables, as_of=None) -> DataFrame:
    return (t.listings.where(F.col("Expiry_Date") < as_of_date(as_of))
            .select("Food_Name", "Expiry_Date"))


def top_provider_type_by_listings(t: Tables, n: int = 1) -> DataFrame:
    return topk(count_by(t.listings, "Provider_Type", "Total_Listings"),
                "Total_Listings", n, ["Provider_Type"])


def top_locations_by_listings(t: Tables, n: int = 5) -> DataFrame:
    g = count_by(t.listings.select(F.col("Location").alias("City")), "City", "Total_Listings")
    return topk(g, "Total_Listings", n, ["City"])


def top_meal_type(t: Tables, n: int = 1) -> DataFrame:
    return topk(count_by(t.listings, "Meal_Type", "Count"), "Count", n, ["Meal_Type"])


def top_food_names(t: Tables, n: int = 5) -> DataFrame:
    return topk(count_by(t.listings, "Food_Name", "Times_Listed"), "Times_Listed", n, ["Food_Name"])


def meals_by_city(t: Tables) -> DataFrame:
    g = (t.listings.groupBy(F.col("Location").alias("City"), "Meal_Type")
         .agg(count_rows("Count")))
    return g.orderBy(F.col("City").asc_nulls_first(), F.col("Meal_Type").asc_nulls_first())


def _distribution(t: Tables, column: str) -> DataFrame:
    """Category counts with NULL excluded (pandas ``value_counts``)."""
    return count_by(t.listings.where(F.col(column).isNotNull()), column, "Count")


def food_type_distribution(t: Tables) -> DataFrame:
    """Counts and share of the non-NULL total, one decimal (the pie chart's data)."""
    g = share_of_total(_distribution(t, "Food_Type"), "Count", "Percentage")
    g = g.withColumn("Percentage", F.round("Percentage", 1))
    return order_desc(g, "Count", ["Food_Type"])


def meal_type_distribution(t: Tables) -> DataFrame:
    return order_desc(_distribution(t, "Meal_Type"), "Count", ["Meal_Type"])
