"""Physical plan shape of every catalogue query."""

import pytest

import __spark_entry__ as entry
from gleaner.plans.catalog import CATALOGUE
from gleaner.sources.roles import AS_OF, role_tables
from gleaner.sources.store import load_tables, save_tables
from gleaner.operators import claims, listings

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def t(spark):
    return role_tables(spark, SF)


@pytest.mark.parametrize("key", sorted(CATALOGUE))
def test_no_cartesian_or_python(key, t):
    p = plan(CATALOGUE[key](t, **entry.PARAMS))
    for node in FORBIDDEN:
        assert node not in p, f"{key}: {node}"


def scans(df, table):
    return plan(df).count(f"{table}.parquet")


def test_unclaimed_reads_each_table_once(t):
    p = claims.unclaimed_listings(t)
    assert scans(p, "lineitem") == 1 and scans(p, "orders") == 1


def test_domain_rules_read_each_table_once(t):
    from gleaner.operators import quality

    p = quality.domain_violations(t)
    assert scans(p, "lineitem") == 1 and scans(p, "orders") == 1 and scans(p, "supplier") == 1


def test_months_are_grouped_before_they_are_formatted(t):
    p = claims.claims_by_month(t)._jdf.queryExecution().optimizedPlan().toString()
    above, rows = p[:p.index("Aggregate")], p[p.index("\n", p.index("Aggregate")):]  # per group, per claim
    group = p[p.index("Aggregate"):p.index("\n", p.index("Aggregate"))]
    assert "trunc(" in rows and "date_format" not in rows and "date_format" in above + group


def test_claims_are_aggregated_before_the_receiver_join(t):
    p = plan(claims.claims_per_receiver_name(t))
    # partial_count on claims sits below the join with receivers.
    assert p.index("partial_count") > p.index("Join")


def test_share_total_reuses_the_grouped_rows(t):
    df = claims.claim_status_percentages(t)
    df.collect()
    # After execution the scalar total reads the grouped shuffle instead of rescanning claims.
    assert "ReusedExchange" in plan(df)


def test_anti_and_semi_joins_see_distinct_keys(t):
    from gleaner.operators import search
    for df in (claims.unclaimed_listings(t), search.contacts_in_view(t, location="NATION_1")):
        p = plan(df)
        assert "HashAggregate(keys=[Food_ID" in p or "HashAggregate(keys=[Provider_ID" in p


def test_date_filters_reach_the_parquet_scan(spark, t, tmp_path):
    save_tables(t, str(tmp_path), files=4)
    stored = load_tables(spark, str(tmp_path))
    p = plan(listings.expired_listings(stored, AS_OF))
    assert "PushedFilters: [IsNotNull(Expiry_Date), LessThan(Expiry_Date," in p
    assert "ReadSchema: struct<Food_Name:string,Expiry_Date:date>" in p
