"""Metrics over one party table (providers or receivers)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import count_by, topk
from gleaner.tables import Tables


def providers_all(t: Tables) -> DataFrame:
    return t.providers


def receivers_all(t: Tables) -> DataFrame:
    return t.receivers


def providers_in_city(t: Tables, city: str) -> DataFrame:
    """Exact, case-sensitive city match."""
    return t.providers.where(F.col("City") == F.lit(city))


def receivers_in_city(t: Tables, city: str) -> DataFrame:
    return t.receivers.where(F.col("City") == F.lit(city))


def provider_contacts_in_city(t: Tables, city: str) -> DataFrame:
    return providers_in_city(t, city).select("Name", "Contact", "Address")


def providers_per_city(t: Tables) -> DataFrame:
    return count_by(t.providers, "City", "num_providers")


def receivers_per_city(t: Tables) -> DataFrame:
    return count_by(t.receivers, "City", "num_receivers")


def providers_by_type(t: Tables) -> DataFrame:
    return count_by(t.providers, "Type", "num_providers")


def receivers_by_type(t: Tables) -> DataFrame:
    return count_by(t.receivers, "Type", "num_receivers")


def top_provider_type(t: Tables, n: int = 1) -> DataFrame:
    g = count_by(t.providers.select(F.col("Type").alias("Provider_Type")), "Provider_Type", "Count")
    return topk(g, "Count", n, ["Provider_Type"])

