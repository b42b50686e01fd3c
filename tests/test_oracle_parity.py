"""Every catalogue query against its DuckDB oracle on the driver's sf0.001 tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from gleaner.plans.catalog import CATALOGUE
from tests.compare import assert_same

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t)}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(CATALOGUE) <= set(ORACLES) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(CATALOGUE))
def test_query_matches_oracle(key, spark, con):
    assert_same(QUERIES[key](spark, SF), con, ORACLES[key])


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["Location", "Wasted_Quantity"] and df.count() > 0
