"""State kept by signed deltas equals recomputation after random batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import claims as claim_metrics
from gleaner.operators import deltas
from gleaner.schema import CLAIMS, FOOD_LISTINGS, change_schema
from gleaner.sources.versions import VersionedTable
from gleaner.tables import Tables
from tests.test_changes_bruteforce import sorted_rows

CITIES, STATES = ["Goa", "Pune", "Delhi", None], ["Pending", "Completed", "Completed", "Cancelled", None]


def listing(rng, key):
    return (key, rng.choice("ab"), rng.choice([None, 1, 2, 30]), None, rng.randint(1, 4), "t", rng.choice(CITIES), "f", "m")


def claim(rng, key):
    return (key, rng.choice([None, *range(1, 14)]), rng.choice([None, 1, 2, 3]), rng.choice(STATES), dt.datetime(2025, 1, 1))


def random_changes(spark, rng, table, make, names, keys):
    rows = []
    for s in range(12):
        op = rng.choice(["insert", "update", "delete"])
        key = None if op == "insert" and rng.random() < 0.5 else rng.choice(keys)
        rows.append((op, s, *make(rng, key), rng.sample(names[1:], 2) if op == "update" else None))
    return spark.createDataFrame(rows, change_schema(table))


def rows_of(df):
    return sorted_rows(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """Random batches through versioned tables and state; each batch's tables, kept and recomputed results."""
    root, rng = str(tmp_path_factory.mktemp("deltas")), random.Random(12)
    listings = spark.createDataFrame([listing(rng, rng.randint(1, 10)) for _ in range(14)] + [listing(rng, None)], FOOD_LISTINGS)
    claims = spark.createDataFrame([claim(rng, rng.randint(1, 30)) for _ in range(30)], CLAIMS)
    lt = VersionedTable.create(listings, f"{root}/l", "Food_ID", 8)
    ct = VersionedTable.create(claims, f"{root}/c", "Claim_ID", 8)
    specs = {"sums": (lt, deltas.Sums(("Location",), ("Quantity", "Provider_ID"))),
             "total": (lt, deltas.Sums((), ("Quantity",))),
             "holders": (ct, deltas.Holders(("Status",), "Receiver_ID"))}
    kept = {}
    for name, (table, spec) in specs.items():
        state = spec.state(table.read())
        keys = [c for c in state.columns if not c.startswith(("rows", "n_", "sum_"))]
        state = state if keys else state.withColumn("all", F.lit(0))
        kept[name] = VersionedTable.create(state, f"{root}/{name}", keys or ["all"], 4)
    foods = VersionedTable.create(deltas.food_state(lt.read(), ct.read()), f"{root}/foods", "Food_ID", 8)
    wasted = VersionedTable.create(deltas.WASTED.state(deltas.contributions(foods.read())), f"{root}/wasted", "Location", 4)
    out = []
    for k in range(4):
        lt.apply(random_changes(spark, rng, "food_listings", listing, FOOD_LISTINGS.names, [*range(1, 14)]))
        ct.apply(random_changes(spark, rng, "claims", claim, CLAIMS.names, [*range(1, 40)]))
        changed = {id(t): deltas.signed(*t.differing(k, k + 1)) for t in (lt, ct)}
        for name, (table, spec) in specs.items():
            delta = spec.state(changed[id(table)])
            if name == "total":
                total = deltas.Sums(("all",), ("Quantity",))
                kept[name].merge(delta.where("rows IS NOT NULL").withColumn("all", F.lit(0)).select("all", *delta.columns)
                                 .select(*kept[name].schema.names), lambda a, b: total.merge(a, b))
            else:
                kept[name].merge(delta, spec.merge)
        foods.merge(deltas.food_delta(*lt.differing(k, k + 1), changed[id(ct)]), deltas.food_after)
        wasted.merge(deltas.WASTED.state(deltas.contributions(deltas.signed(*foods.differing(k, k + 1)))), deltas.WASTED.merge)
        tables = Tables(None, None, lt.read(), ct.read())
        out.append((tables, {n: t.read() for n, t in kept.items()}, foods.read(), wasted.read()))
    return specs, out


def test_sums_and_holders_equal_recomputation(run):
    specs, out = run
    for tables, kept, _, _ in out:
        assert rows_of(kept["sums"]) == rows_of(specs["sums"][1].state(tables.listings))
        assert rows_of(kept["holders"]) == rows_of(specs["holders"][1].state(tables.claims))
        now = kept["total"].drop("all").collect()
        assert [tuple(r) for r in now] == [tuple(r) for r in specs["total"][1].state(tables.listings).collect()]


def test_results_read_from_state_equal_the_queries(run):
    specs, out = run
    spec, who = specs["sums"][1], specs["holders"][1]
    for tables, kept, _, _ in out:
        assert rows_of(kept["sums"].select("Location", spec.total("Quantity"), spec.mean("Quantity"))) == rows_of(
            tables.listings.groupBy("Location").agg(F.sum("Quantity"), F.avg("Quantity")))
        assert rows_of(who.distinct(kept["holders"], "n")) == rows_of(
            tables.claims.groupBy("Status").agg(F.count_distinct("Receiver_ID")))
        for read, fn in ((who.highest, F.max), (who.lowest, F.min)):
            assert rows_of(read(kept["holders"], "n")) == rows_of(tables.claims.groupBy("Status").agg(fn("Receiver_ID")))


def test_wasted_quantity_from_state_equals_the_query(run):
    _, out = run
    for tables, _, foods, wasted in out:
        assert rows_of(foods) == rows_of(deltas.food_state(tables.listings, tables.claims))
        assert rows_of(deltas.wasted(wasted)) == rows_of(claim_metrics.wasted_quantity_by_location(tables))


def test_equal_rows_cancel_and_copies_are_counted(spark):
    schema = "k long, v string"
    old = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], schema)
    new = spark.createDataFrame([(1, "a"), (2, None), (4, "d"), (4, "d"), (None, None)], schema)
    assert rows_of(deltas.signed(old, new)) == sorted_rows([(1, "a", -1), (3, "c", -1), (4, "d", 2), (None, None, 1)])
    plan = deltas.signed(old, new)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan  # a row that both sides repeat is one row a task


def test_a_batch_reads_the_buckets_it_changes(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 5).alias("g"))
    table = VersionedTable.create(rows, str(tmp_path / "t"), "k", 32)
    one = spark.createDataFrame([("delete", 1, 7, None, None)], "op string, seq long, k long, g long, set_columns array<string>")
    table.apply(one)
    old, new = table.differing(0, 1)
    assert len(old.inputFiles()) <= 2 < len(table.read(0).inputFiles())
    assert old.count() == new.count() + 1 < 100
    assert rows_of(deltas.signed(old, new)) == [(7, 2, -1)]
