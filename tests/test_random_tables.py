"""Every catalogue key on empty tables and on seeded random tables vs DuckDB.

Random tables draw keys from small ranges (so duplicate keys, orphans and
unmatched rows occur), names from a few values (namesakes), and put NULLs in
every column.
"""

import datetime as D
import random

import duckdb
import pytest

import __spark_entry__ as entry
from gleaner.plans.catalog import CATALOGUE
from gleaner.schema import CLAIMS, FOOD_LISTINGS, PROVIDERS, RECEIVERS
from gleaner.tables import Tables
from tests.compare import assert_same
from tests.fixtures import PARAMS

CITIES = ["Delhi", "Mumbai", "Pune", "Goa"]


def maybe(rng, value, p=0.1):
    return None if rng.random() < p else value


def random_rows(seed):
    rng = random.Random(seed)
    prov = [(maybe(rng, rng.randint(1, 30), 0.03), maybe(rng, rng.choice(["Asha", "Bina", "Chand", "Dev"])),
             maybe(rng, rng.choice(["Restaurant", "Household", "Hotel"])), maybe(rng, "addr"),
             maybe(rng, rng.choice(CITIES)), maybe(rng, rng.choice(["a@b.c", "12345"])))
            for _ in range(35)]
    recv = [(maybe(rng, rng.randint(1, 20), 0.03), maybe(rng, rng.choice(["Ravi", "Sita", "Tara"])),
             maybe(rng, rng.choice(["NGO", "Individual"])), maybe(rng, rng.choice(CITIES[1:] + ["Agra"])),
             maybe(rng, "r@x.y"))
            for _ in range(25)]
    base = D.date(2025, 3, 17)
    lst = [(maybe(rng, rng.randint(1, 120), 0.03), maybe(rng, rng.choice(["Rice", "Dal", "Roti", "Soup", "Curd"])),
            maybe(rng, rng.randint(0, 50)), maybe(rng, base + D.timedelta(days=rng.randint(-10, 10))),
            maybe(rng, rng.randint(1, 35), 0.05), maybe(rng, rng.choice(["Restaurant", "Household"])),
            maybe(rng, rng.choice(CITIES)), maybe(rng, rng.choice(["Veg", "Non-Veg"])),
            maybe(rng, rng.choice(["Lunch", "Dinner", "Snack"])))
           for _ in range(110)]
    clm = [(maybe(rng, rng.randint(1, 400), 0.03), maybe(rng, rng.randint(1, 130), 0.05),
            maybe(rng, rng.randint(1, 22), 0.05), maybe(rng, rng.choice(["Pending", "Completed", "Cancelled"])),
            maybe(rng, D.datetime(2025, 3, rng.randint(1, 28), rng.randint(0, 23), rng.randint(0, 59))))
           for _ in range(400)]
    return prov, recv, lst, clm


def build(spark, tmp, rows):
    schemas = [PROVIDERS, RECEIVERS, FOOD_LISTINGS, CLAIMS]
    names = ["providers", "receivers", "food_listings", "claims"]
    con = duckdb.connect()
    frames = []
    for name, schema, data in zip(names, schemas, rows):
        path = f"{tmp}/{name}"
        spark.createDataFrame(data, schema).coalesce(1).write.mode("overwrite").parquet(path)
        frames.append(spark.read.schema(schema).parquet(path))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return Tables(*frames), con


@pytest.fixture(scope="module", params=[7, 2024])
def random_tables(request, spark, tmp_path_factory):
    return build(spark, str(tmp_path_factory.mktemp(f"rand{request.param}")), random_rows(request.param))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return build(spark, str(tmp_path_factory.mktemp("empty")), ([], [], [], []))


BODIES = entry.oracle_bodies(PARAMS)


@pytest.mark.parametrize("key", sorted(CATALOGUE))
def test_random_tables(key, random_tables):
    t, con = random_tables
    assert_same(CATALOGUE[key](t, **PARAMS), con, BODIES[key])


@pytest.mark.parametrize("key", sorted(CATALOGUE))
def test_empty_tables(key, empty):
    t, con = empty
    assert_same(CATALOGUE[key](t, **PARAMS), con, BODIES[key])
