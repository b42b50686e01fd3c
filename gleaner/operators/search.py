"""Search, dashboard filters and the contact list.

Everything is a lazy filter or semi join; nothing is pulled to the driver
except the single row count a caller may ask for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import matches_any
from gleaner.tables import Tables

ALL = "All"
LISTING_SEARCH_COLUMNS = ("Food_Name", "Location", "Provider_Type")
CONTACT_SEARCH_COLUMNS = ("City", "Name")
CONTACT_COLUMNS = ("Provider_ID", "Name", "Type", "City", "Contact")


def _active(value) -> bool:
    return value is not None and value != ALL


def search_listings(t: Tables, pattern: str, literal: bool = False) -> DataFrame:
    """Listings whose name, location or provider type matches; blank = all."""
    if pattern is None or pattern.strip() == "":
        return t.listings
    return t.listings.where(matches_any(LISTING_SEARCH_COLUMNS, pattern, literal))


def search_contacts(t: Tables, pattern: str, literal: bool = False) -> DataFrame:
    """The provider contact list, searched by city or name; blank = all."""
    contacts = t.providers.select(*CONTACT_COLUMNS)
    if pattern is None or pattern.strip() == "":
        return contacts
    return contacts.where(matches_any(CONTACT_SEARCH_COLUMNS, pattern, literal))


def provider_id_for_name(t: Tables, name: str) -> DataFrame:
    """One row: the smallest Provider_ID carrying ``name`` (no row if none)."""
    return (t.providers.where(F.col("Name") == F.lit(name))
            .agg(F.min("Provider_ID").alias("Provider_ID"))
            .where(F.col("Provider_ID").isNotNull()))


def filter_listings(t: Tables, location: str | None = None, provider_name: str | None = None,
                    food_type: str | None = None) -> DataFrame:
    """Conjunctive dashboard filters; ``None`` or ``"All"`` leaves a filter off.

    A provider is chosen by name and stands for the first id of that name, so
    other providers sharing the name are not included.
    """
    df = t.listings
    if _active(location):
        df = df.where(F.col("Location") == F.lit(location))
    if _active(food_type):
        df = df.where(F.col("Food_Type") == F.lit(food_type))
    if _active(provider_name):
        # A one-row global aggregate: its size is bounded, so it can be broadcast.
        df = df.join(F.broadcast(provider_id_for_name(t, provider_name)), "Provider_ID", "left_semi")
    return df


def filter_options(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-NULL values of a column, ascending."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def location_options(t: Tables) -> DataFrame:
    return filter_options(t.listings, "Location")


def provider_name_options(t: Tables) -> DataFrame:
    return filter_options(t.providers, "Name")


def food_type_options(t: Tables) -> DataFrame:
    return filter_options(t.listings, "Food_Type")


def contact_link(column: str = "Contact"):
    """``mailto:`` link when the contact holds an '@', else the contact as is."""
    c = F.col(column)
    return F.when(c.contains("@"), F.concat(F.lit("mailto:"), c)).otherwise(c)


def providers_in_view(t: Tables, listings_view: DataFrame) -> DataFrame:
    """Providers that appear in a (filtered) listing view, with a contact link."""
    in_view = listings_view.select("Provider_ID").distinct()  # one row per provider, skew-safe
    return (t.providers.join(in_view, "Provider_ID", "left_semi")
            .select("Provider_ID", "Name", "Address", "Contact",
                    contact_link().alias("Contact_Link")))


def contacts_in_view(t: Tables, location: str | None = None, provider_name: str | None = None,
                     food_type: str | None = None) -> DataFrame:
    return providers_in_view(t, filter_listings(t, location, provider_name, food_type))


def row_count(df: DataFrame) -> int:
    """Number of rows in a view (the '<n> results found' line)."""
    return df.count()
