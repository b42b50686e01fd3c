"""Invariants between metrics, on the driver's sf0.001 tables."""

import pytest
from pyspark.sql import functions as F

from gleaner.operators import claims, listings, parties
from gleaner.sources.roles import AS_OF, role_tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return role_tables(spark, SF)


def test_status_counts_sum_to_rows(t):
    assert claims.claims_by_status(t).agg(F.sum("Count")).first()[0] == t.claims.count()


def test_percentages_sum_to_100(t):
    total = claims.claim_status_percentages(t).agg(F.sum("Percentage")).first()[0]
    assert abs(total - 100.0) < 1e-9


def test_unclaimed_and_claimed_partition_listings(t):
    unclaimed = claims.unclaimed_listings(t).count()
    claimed = t.listings.join(t.claims.select("Food_ID"), "Food_ID", "left_semi").count()
    assert unclaimed + claimed == t.listings.count()


def test_with_zero_restricted_equals_inner(t):
    a = {r[0]: r[1] for r in claims.claims_per_receiver_name(t).collect()}
    b = {r[0]: r[1] for r in claims.claims_per_receiver_with_zero(t).where("Claims_Made > 0").collect()}
    assert a == b


def test_wasted_total(t):
    wasted = claims.wasted_quantity_by_location(t).agg(F.sum("Wasted_Quantity")).first()[0]
    total = t.listings.agg(F.sum("Quantity")).first()[0]
    done = (t.claims.where("Status = 'Completed'")
            .join(t.listings.select("Food_ID"), "Food_ID", "left_semi").count())
    assert wasted == total - done


def test_expiring_includes_expired(t):
    expired = listings.expired_listings(t, AS_OF).count()
    assert listings.expiring_within(t, AS_OF, 3).count() >= expired


def test_per_city_counts_sum_to_rows(t):
    assert parties.providers_per_city(t).agg(F.sum("num_providers")).first()[0] == t.providers.count()
