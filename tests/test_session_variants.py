"""Every catalogue query under other session settings: AQE off, ANSI off, 200 partitions."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from gleaner.plans.catalog import CATALOGUE
from tests.compare import assert_same

SF = "/root/testdata/sf0.001"
VARIANT = {"spark.sql.adaptive.enabled": "false", "spark.sql.ansi.enabled": "false",
           "spark.sql.shuffle.partitions": "200"}
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t)}.parquet')")
    return c


@pytest.fixture(scope="module")
def variant(spark):
    old = {k: spark.conf.get(k, None) for k in VARIANT}
    for k, v in VARIANT.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("key", sorted(CATALOGUE))
def test_query_matches_oracle_without_aqe_or_ansi(key, spark, con, variant):
    assert_same(QUERIES[key](spark, SF), con, ORACLES[key])
