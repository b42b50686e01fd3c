"""Stored tables bucketed by Food_ID: same results, no claims shuffle for Food_ID joins."""

import duckdb
import pytest

import __spark_entry__ as entry
from gleaner.operators import claims
from gleaner.plans.catalog import CATALOGUE
from gleaner.sources.store import load_tables, save_tables
from tests.compare import assert_same
from tests.fixtures import PARAMS

NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture(scope="module")
def bucketed(spark, edge, tmp_path_factory):
    t, paths = edge
    root = str(tmp_path_factory.mktemp("bucketed"))
    save_tables(t, root, buckets=4)
    con = duckdb.connect()
    for name, path in paths.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return load_tables(spark, root), con


@pytest.fixture
def no_broadcast(spark):
    old = {k: spark.conf.get(k, None) for k in NO_BROADCAST}
    for k, v in NO_BROADCAST.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


BODIES = entry.oracle_bodies(PARAMS)


@pytest.mark.parametrize("key", sorted(CATALOGUE))
def test_bucketed_tables_give_same_results(key, bucketed):
    t, con = bucketed
    assert_same(CATALOGUE[key](t, **PARAMS), con, BODIES[key])


def test_food_id_join_has_no_exchange_below_the_sort(bucketed, no_broadcast):
    t, _ = bucketed
    df = claims.claims_per_food_id(t)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Bucketed: true" in plan
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan
