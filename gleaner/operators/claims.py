"""Metrics over claims, alone and joined to listings and receivers (demand side).

Claims are the largest table. Every join metric first aggregates claims by the
join key (partial aggregation before the shuffle collapses hot keys), then
joins the much smaller per-key result to a dimension, and only then groups by
the output key. Grouping by name merges namesakes; grouping by id keeps them
apart and reports ``min(name)`` for the id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import count_by, order_desc, share_of_total, topk
from gleaner.functions.dates import as_of_date
from gleaner.schema import COMPLETED
from gleaner.tables import Tables


def claims_per_key(claims: DataFrame, key: str, alias: str = "n") -> DataFrame:
    """``COUNT(Claim_ID)`` per key; NULL Claim_IDs are not counted."""
    return claims.groupBy(key).agg(F.count("Claim_ID").alias(alias))


def claims_by_status(t: Tables) -> DataFrame:
    return count_by(t.claims, "Status", "Count")


def claims_by_date(t: Tables) -> DataFrame:
    g = count_by(t.claims.select(F.to_date("Timestamp").alias("Claim_Date")),
                 "Claim_Date", "Total_Claims")
    return g.orderBy(F.col("Claim_Date").desc_nulls_last())


def claims_by_month(t: Tables) -> DataFrame:
    # Grouped by the first day of the month; only the groups are formatted.
    g = count_by(t.claims.select(F.trunc(F.to_date("Timestamp"), "month").alias("_m")), "_m", "num_claims")
    return g.select(F.date_format("_m", "yyyy-MM").alias("claim_month"), "num_claims")


def claim_status_percentages(t: Tables) -> DataFrame:
    g = count_by(t.claims, "Status", "_n")
    return share_of_total(g, "_n", "Percentage").select("Status", "Percentage")


def _per_food_joined(t: Tables, columns: list[str]) -> DataFrame:
    """Claims counted per Food_ID, joined to the listing columns wanted.

    The inner join keeps listing multiplicity: a Food_ID listed twice counts
    its claims twice, as the row-level join would.
    """
    return claims_per_key(t.claims, "Food_ID").join(t.listings.select("Food_ID", *columns), "Food_ID")


def claims_per_food_name(t: Tables) -> DataFrame:
    g = (_per_food_joined(t, ["Food_Name"]).groupBy("Food_Name")
         .agg(F.sum("n").alias("claim_count")))
    return order_desc(g, "claim_count", ["Food_Name"])


def claims_per_food_id(t: Tables) -> DataFrame:
    g = (_per_food_joined(t, ["Food_Name"]).groupBy("Food_ID")
         .agg(F.min("Food_Name").alias("Food_Name"), F.sum("n").alias("Claim_Count")))
    return order_desc(g, "Claim_Count", ["Food_Name", "Food_ID"]).select("Food_Name", "Claim_Count")


def most_claimed_meal_type(t: Tables, n: int = 1) -> DataFrame:
    g = (_per_food_joined(t, ["Meal_Type"]).groupBy("Meal_Type")
         .agg(F.sum("n").alias("ClaimCount")))
    return topk(g, "ClaimCount", n, ["Meal_Type"])


def highest_demand_location(t: Tables, n: int = 1) -> DataFrame:
    g = (_per_food_joined(t, ["Location"]).groupBy(F.col("Location").alias("City"))
         .agg(F.sum("n").alias("Total_Claims")))
    return topk(g, "Total_Claims", n, ["City"])


def _receiver_counts_by_name(per_receiver: DataFrame, t: Tables, alias: str,
                             name_alias: str = "Name", how: str = "inner") -> DataFrame:
    """Per-receiver counts joined to receivers, summed per receiver name."""
    j = t.receivers.select("Receiver_ID", "Name").join(per_receiver, "Receiver_ID", how)
    return (j.groupBy(F.col("Name").alias(name_alias))
            .agg(F.sum(F.coalesce(F.col("n"), F.lit(0))).alias(alias)))


def claims_per_receiver_name(t: Tables) -> DataFrame:
    g = _receiver_counts_by_name(claims_per_key(t.claims, "Receiver_ID"), t, "total_claims")
    return order_desc(g, "total_claims", ["Name"])


def claims_per_receiver_with_zero(t: Tables) -> DataFrame:
    """Every receiver name, 0 for receivers without claims (left join)."""
    g = _receiver_counts_by_name(claims_per_key(t.claims, "Receiver_ID"), t, "Claims_Made",
                                 how="left")
    return order_desc(g, "Claims_Made", ["Name"])


def claims_per_receiver_id(t: Tables) -> DataFrame:
    j = (t.receivers.select("Receiver_ID", "Name")
         .join(claims_per_key(t.claims, "Receiver_ID"), "Receiver_ID"))
    g = j.groupBy("Receiver_ID").agg(F.min("Name").alias("ReceiverName"),
                                    F.sum("n").alias("ClaimCount"))
    return (order_desc(g, "ClaimCount", ["ReceiverName", "Receiver_ID"])
            .select("ReceiverName", "ClaimCount"))


def _claims_of_listings(t: Tables, listing_filter) -> DataFrame:
    """Claims whose listing passes a filter; an inner join keeps multiplicity."""
    keys = t.listings.where(listing_filter).select("Food_ID")
    return t.claims.select("Food_ID", "Receiver_ID", "Claim_ID").join(keys, "Food_ID")


def top_receivers_by_food_type(t: Tables, food_type: str, n: int = 5) -> DataFrame:
    c = _claims_of_listings(t, F.col("Food_Type") == F.lit(food_type))
    g = _receiver_counts_by_name(claims_per_key(c, "Receiver_ID"), t, "NonVeg_Claims")
    return topk(g, "NonVeg_Claims", n, ["Name"])


def expired_claims_per_receiver(t: Tables, as_of=None) -> DataFrame:
    c = _claims_of_listings(t, F.col("Expiry_Date") < as_of_date(as_of))
    g = _receiver_counts_by_name(claims_per_key(c, "Receiver_ID"), t, "expired_claims",
                                 name_alias="receiver_name")
    return order_desc(g, "expired_claims", ["receiver_name"])


def avg_quantity_claimed(t: Tables) -> DataFrame:
    """Average listed quantity over a receiver's claims (all statuses), by receiver id."""
    j = t.claims.select("Food_ID", "Receiver_ID").join(
        t.listings.select("Food_ID", "Quantity"), "Food_ID")
    per = j.groupBy("Receiver_ID").agg(F.sum("Quantity").alias("sq"),
                                       F.count("Quantity").alias("nq"))
    g = (t.receivers.select("Receiver_ID", "Name").join(per, "Receiver_ID")
         .groupBy("Receiver_ID")
         .agg(F.min("Name").alias("ReceiverName"),
              F.try_divide(F.sum("sq").cast("double"), F.sum("nq")).alias("Avg_Quantity_Claimed")))
    return g.select("ReceiverName", "Avg_Quantity_Claimed")


def unclaimed_listings(t: Tables) -> DataFrame:
    """Listings without a claim, and once for each of their claims whose Claim_ID is NULL.

    That is what a left join tested for a NULL Claim_ID returns. Claims are counted per
    Food_ID first, with and without an id, so both tables are read once and a hot
    Food_ID collapses before the shuffle.
    """
    cols = ["Food_ID", "Food_Name", "Quantity", "Expiry_Date"]
    counts = t.claims.groupBy("Food_ID").agg(F.count(F.lit(1)).alias("_rows"), F.count("Claim_ID").alias("_ids"))
    times = F.when(F.col("_rows").isNull(), 1).otherwise(F.col("_rows") - F.col("_ids")).cast("int")
    j = (t.listings.select(*cols).join(counts, "Food_ID", "left").withColumn("_times", times)
         .where(F.col("_times") > 0))
    return j.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).select(*cols)


def wasted_quantity_by_location(t: Tables) -> DataFrame:
    """Per location: listed quantity minus the number of completed claims.

    The reference subtracts a count from a quantity; the formula is kept. The
    status test belongs to the join condition, so unclaimed listings stay in.
    Its inner query groups by Food_ID and reads Location and Quantity bare;
    ``min`` stands for that one value.
    """
    completed = claims_per_key(t.claims.where(F.col("Status") == F.lit(COMPLETED)),
                               "Food_ID", "completed")
    # Join first, then group by Food_ID on the join's order: Food_ID is nearly unique, so a grouping of
    # the listings before the join would shrink nothing and sort them once more.
    per_food = (t.listings.select("Food_ID", "Location", "Quantity").join(completed, "Food_ID", "left")
                .groupBy("Food_ID").agg(F.min("Location").alias("Location"), F.min("Quantity").alias("Quantity"),
                                        F.sum(F.coalesce("completed", F.lit(0))).alias("claimed_count")))
    g = per_food.groupBy("Location").agg(
        (F.sum("Quantity") - F.coalesce(F.sum("claimed_count"), F.lit(0))).alias("Wasted_Quantity"))
    return order_desc(g, "Wasted_Quantity", ["Location"])


def completed_claims_detail(t: Tables) -> DataFrame:
    """Completed claims with provider and receiver names (row-level, no aggregate).

    Listings meet providers first (listing-sized join), so the claims stream is
    shuffled once by Food_ID and once by Receiver_ID; hot keys on either join
    are split by AQE's skew-join handling.
    """
    food_provider = t.listings.select("Food_ID", "Provider_ID").join(
        t.providers.select("Provider_ID", F.col("Name").alias("Provider")), "Provider_ID")
    c = (t.claims.where(F.col("Status") == F.lit(COMPLETED))
         .select("Claim_ID", "Food_ID", "Receiver_ID", "Status", "Timestamp"))
    j = c.join(food_provider.select("Food_ID", "Provider"), "Food_ID").join(
        t.receivers.select("Receiver_ID", F.col("Name").alias("Receiver")), "Receiver_ID")
    return j.select("Claim_ID", "Provider", "Receiver", "Status", "Timestamp")
