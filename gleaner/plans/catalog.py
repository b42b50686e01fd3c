"""Named catalogue: key -> operator plus the parameters it takes.

A key is what the reference calls a saved query. ``run`` binds parameters by
name, so one parameter set (``as_of``, ``city``, ``food_type``) serves the whole
catalogue.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from gleaner.operators import cities, claims, listings, parties, search, supply, quality
from gleaner.plans import approx, roundtrip, upkeep, versioned
from gleaner.tables import Tables


@dataclass(frozen=True)
class Metric:
    """An operator, the catalogue parameters it reads and fixed arguments.

    ``params`` names catalogue parameters; ``"arg=param"`` passes catalogue
    parameter ``param`` as the operator's argument ``arg``.
    """
    fn: Callable[..., DataFrame]
    params: tuple[str, ...] = ()
    fixed: dict = field(default_factory=dict)

    def bindings(self) -> dict[str, str]:
        return dict(p.split("=", 1) if "=" in p else (p, p) for p in self.params)

    def __call__(self, tables: Tables, **params) -> DataFrame:
        binds = self.bindings()
        missing = [p for p in binds.values() if p not in params]
        if missing:
            raise TypeError(f"missing parameters: {missing}")
        return self.fn(tables, **{a: params[p] for a, p in binds.items()}, **self.fixed)


CATALOGUE: dict[str, Metric] = {
    # Single-table scans and filters.
    "providers_all": Metric(parties.providers_all),
    "receivers_all": Metric(parties.receivers_all),
    "providers_in_city": Metric(parties.providers_in_city, ("city",)),
    "receivers_in_city": Metric(parties.receivers_in_city, ("city",)),
    "provider_contacts_in_city": Metric(parties.provider_contacts_in_city, ("city",)),
    "expiring_within": Metric(listings.expiring_within, ("as_of",), {"days": 3}),
    "expired_listings": Metric(listings.expired_listings, ("as_of",)),
    # Single-table aggregates.
    "total_quantity": Metric(listings.total_quantity),
    "avg_quantity": Metric(listings.avg_quantity),
    "listings_by_food_type": Metric(listings.listings_by_food_type),
    "listings_by_meal_type": Metric(listings.listings_by_meal_type),
    "listings_by_provider_type": Metric(listings.listings_by_provider_type),
    "avg_quantity_by_provider_type": Metric(listings.avg_quantity_by_provider_type),
    "quantity_by_location": Metric(listings.quantity_by_location),
    "meals_by_city": Metric(listings.meals_by_city),
    "top_provider_type_by_listings": Metric(listings.top_provider_type_by_listings, (), {"n": 1}),
    "top_locations_by_listings": Metric(listings.top_locations_by_listings, (), {"n": 5}),
    "city_with_most_listings": Metric(listings.top_locations_by_listings, (), {"n": 1}),
    "top_meal_type": Metric(listings.top_meal_type, (), {"n": 1}),
    "top_food_names": Metric(listings.top_food_names, (), {"n": 5}),
    "food_type_distribution": Metric(listings.food_type_distribution),
    "meal_type_distribution": Metric(listings.meal_type_distribution),
    "providers_per_city": Metric(parties.providers_per_city),
    "receivers_per_city": Metric(parties.receivers_per_city),
    "providers_by_type": Metric(parties.providers_by_type),
    "receivers_by_type": Metric(parties.receivers_by_type),
    "top_provider_type": Metric(parties.top_provider_type, (), {"n": 1}),
    "claims_by_status": Metric(claims.claims_by_status),
    "claims_by_date": Metric(claims.claims_by_date),
    "claims_by_month": Metric(claims.claims_by_month),
    "claim_status_percentages": Metric(claims.claim_status_percentages),
    # Joins, grouped by name (namesakes merge) or by id.
    "top_providers_by_quantity_name": Metric(supply.top_providers_by_quantity_name, (), {"n": 5}),
    "quantity_per_provider_name": Metric(supply.quantity_per_provider_name),
    "listings_per_provider_name": Metric(supply.listings_per_provider_name),
    "top_providers_by_listings_with_zero": Metric(supply.top_providers_by_listings_with_zero, (), {"n": 5}),
    "quantity_per_provider_id": Metric(supply.quantity_per_provider_id),
    "top_provider_by_completed": Metric(supply.top_provider_by_completed, (), {"n": 1}),
    "claims_per_food_name": Metric(claims.claims_per_food_name),
    "claims_per_food_id": Metric(claims.claims_per_food_id),
    "claims_per_receiver_name": Metric(claims.claims_per_receiver_name),
    "claims_per_receiver_with_zero": Metric(claims.claims_per_receiver_with_zero),
    "claims_per_receiver_id": Metric(claims.claims_per_receiver_id),
    "top_receivers_by_food_type": Metric(claims.top_receivers_by_food_type, ("food_type",), {"n": 5}),
    "expired_claims_per_receiver": Metric(claims.expired_claims_per_receiver, ("as_of",)),
    "avg_quantity_claimed": Metric(claims.avg_quantity_claimed),
    "most_claimed_meal_type": Metric(claims.most_claimed_meal_type, (), {"n": 1}),
    "highest_demand_location": Metric(claims.highest_demand_location, (), {"n": 1}),
    "unclaimed_listings": Metric(claims.unclaimed_listings),
    "wasted_quantity_by_location": Metric(claims.wasted_quantity_by_location),
    "completed_claims_detail": Metric(claims.completed_claims_detail),
    # City-level.
    "city_counts_left": Metric(cities.city_counts_left),
    "city_counts_union": Metric(cities.city_counts_union),
    "city_conditional_distinct": Metric(cities.city_conditional_distinct),
    "city_flow": Metric(cities.city_flow),
    # Distinct counts from sketches, beside the exact ones.
    "city_counts_sketched": Metric(approx.city_counts_sketched),
    "city_conditional_sketched": Metric(approx.city_conditional_sketched),
    "monthly_reach_sketched": Metric(approx.monthly_reach_sketched),
    # Search, dashboard filters, contact list.
    "search_listings": Metric(search.search_listings, ("pattern=listing_pattern",)),
    "listings_searched_by_index": Metric(roundtrip.listings_searched_by_index, ("pattern=listing_pattern",)),
    "search_contacts": Metric(search.search_contacts, ("pattern=contact_pattern",)),
    "filter_listings": Metric(search.filter_listings, ("location=city", "food_type")),
    "filter_listings_by_provider": Metric(search.filter_listings, ("provider_name",)),
    "location_options": Metric(search.location_options),
    "provider_name_options": Metric(search.provider_name_options),
    "food_type_options": Metric(search.food_type_options),
    "contacts_in_view": Metric(search.contacts_in_view, ("location=city", "food_type")),
    # Integrity checks.
    "domain_violations": Metric(quality.domain_violations),
    "orphan_references": Metric(quality.orphan_references),
    "duplicate_keys": Metric(quality.duplicate_keys_all),
    # Change operators applied to changes derived from the tables.
    "claims_renumbered": Metric(upkeep.claims_renumbered),
    "listings_without_expired": Metric(upkeep.listings_without_expired, ("as_of",)),
    "listings_quantity_settled": Metric(upkeep.listings_quantity_settled),
    "claims_reissued": Metric(upkeep.claims_reissued),
    "claims_withdrawn": Metric(upkeep.claims_withdrawn),
    "claims_of_expired": Metric(upkeep.claims_of_expired, ("as_of",)),
    "claims_via_store": Metric(upkeep.claims_via_store),
    "listings_after_changes": Metric(upkeep.listings_after_changes, ("as_of",)),
    # Change batches through versioned tables; aggregates kept by signed deltas.
    "listings_after_commits": Metric(versioned.listings_after_commits, ("as_of",)),
    "listings_row_counts": Metric(versioned.listings_row_counts, ("as_of",)),
    "claims_of_two_writers": Metric(versioned.claims_of_two_writers),
    "quantity_kept_by_location": Metric(versioned.quantity_kept_by_location, ("as_of",)),
    "reach_kept_by_status": Metric(versioned.reach_kept_by_status),
    "wasted_kept_by_location": Metric(versioned.wasted_kept_by_location, ("as_of",)),
    # CSV ingest on whole tables (each row as a CSV line, parsed back typed).
    "listings_via_csv": Metric(roundtrip.listings_via_csv),
    "claims_via_csv": Metric(roundtrip.claims_via_csv),
    "listings_via_csv_files": Metric(roundtrip.listings_via_csv_files),
}


def run(key: str, tables: Tables, **params) -> DataFrame:
    return CATALOGUE[key](tables, **params)
