"""Metrics joining listings to providers (who gives what)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import order_desc, topk
from gleaner.schema import COMPLETED
from gleaner.tables import Tables


def _per_provider(t: Tables, **aggs) -> DataFrame:
    """Listings aggregated per Provider_ID before meeting the providers table."""
    return t.listings.groupBy("Provider_ID").agg(*[c.alias(a) for a, c in aggs.items()])


def _by_name(per: DataFrame, t: Tables, measure: str, alias: str,
             name_alias: str = "Name", how: str = "inner") -> DataFrame:
    j = t.providers.select("Provider_ID", "Name").join(per, "Provider_ID", how)
    total = F.sum(F.col(measure))
    if how == "left":
        total = F.sum(F.coalesce(F.col(measure), F.lit(0)))
    return j.groupBy(F.col("Name").alias(name_alias)).agg(total.alias(alias))


def top_providers_by_quantity_name(t: Tables, n: int = 5) -> DataFrame:
    g = _by_name(_per_provider(t, q=F.sum("Quantity")), t, "q", "total")
    return topk(g, "total", n, ["Name"])


def quantity_per_provider_name(t: Tables) -> DataFrame:
    g = _by_name(_per_provider(t, q=F.sum("Quantity")), t, "q", "total_quantity",
                 name_alias="provider_name")
    return order_desc(g, "total_quantity", ["provider_name"])


def listings_per_provider_name(t: Tables) -> DataFrame:
    g = _by_name(_per_provider(t, k=F.count("Food_ID")), t, "k", "num_listings",
                 name_alias="provider_name")
    return order_desc(g, "num_listings", ["provider_name"])


def top_providers_by_listings_with_zero(t: Tables, n: int = 5) -> DataFrame:
    """Providers ranked by listings, those without listings counted as 0."""
    g = _by_name(_per_provider(t, k=F.count("Food_ID")), t, "k", "Foods_Provided", how="left")
    return topk(g, "Foods_Provided", n, ["Name"])


def quantity_per_provider_id(t: Tables) -> DataFrame:
    j = t.providers.select("Provider_ID", "Name").join(
        _per_provider(t, q=F.sum("Quantity")), "Provider_ID")
    g = j.groupBy("Provider_ID").agg(F.min("Name").alias("ProviderName"),
                                    F.sum("q").alias("Total_Donated"))
    return (order_desc(g, "Total_Donated", ["ProviderName", "Provider_ID"])
            .select("ProviderName", "Total_Donated"))


def top_provider_by_completed(t: Tables, n: int = 1) -> DataFrame:
    """Provider (by id) whose listings got the most completed claims."""
    done = (t.claims.where(F.col("Status") == F.lit(COMPLETED))
            .groupBy("Food_ID").agg(F.count("Claim_ID").alias("n")))
    per_provider = (done.join(t.listings.select("Food_ID", "Provider_ID"), "Food_ID")
                    .groupBy("Provider_ID").agg(F.sum("n").alias("n")))
    g = (t.providers.select("Provider_ID", "Name").join(per_provider, "Provider_ID")
         .groupBy("Provider_ID").agg(F.min("Name").alias("ProviderName"),
                                     F.sum("n").alias("Successful_Claims")))
    return (topk(g, "Successful_Claims", n, ["ProviderName", "Provider_ID"])
            .select("ProviderName", "Successful_Claims"))
