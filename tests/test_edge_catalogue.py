"""Every catalogue key on the edge tables against the oracle SQL run by DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from gleaner.plans.catalog import CATALOGUE
from tests.compare import assert_same
from tests.fixtures import PARAMS

BODIES = entry.oracle_bodies(PARAMS)


@pytest.fixture(scope="module")
def con(edge):
    _, paths = edge
    c = duckdb.connect()
    for name, path in paths.items():
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(CATALOGUE))
def test_key_matches_oracle(key, edge, con):
    tables, _ = edge
    assert_same(CATALOGUE[key](tables, **PARAMS), con, BODIES[key])
