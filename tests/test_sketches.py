"""Sketches: merges equal sketches of the whole, estimates within the stated error, stored loads and deletes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleaner.operators import cities, sketches
from gleaner.schema import CLAIMS, FOOD_LISTINGS, PROVIDERS, RECEIVERS
from gleaner.sources.roles import role_tables
from gleaner.tables import Tables

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def t(spark):
    return role_tables(spark, SF)


def test_union_of_sketches_equals_the_sketch_of_the_union(spark):
    rows = spark.range(200_000).select("id", (F.col("id") % 7).alias("part"), F.lit(1).alias("all"))
    parts = sketches.merge_by(sketches.sketch_by(rows, ["all", "part"], {"n": "id"}), ["all"])
    whole = sketches.merge_by(sketches.sketch_by(rows, ["all"], {"n": "id"}), ["all"])
    assert sketches.estimates(parts).first()["n"] == sketches.estimates(whole).first()["n"]


@pytest.mark.parametrize("lg_k", [8, 12])
def test_estimates_are_within_the_stated_error(spark, lg_k):
    rows = spark.range(300_000).select("id", (F.col("id") % 40).alias("g"))
    got = sketches.estimates(sketches.merge_by(sketches.sketch_by(rows, ["g"], {"n": "id"}, lg_k), ["g"]))
    exact = rows.groupBy(F.col("g").alias("k")).agg(F.count_distinct("id").alias("m"))
    both = got.join(exact, F.col("g") == F.col("k"))
    assert both.where(~sketches.within("n", "m", lg_k)).count() == 0
    assert both.where(F.col("n") != F.col("m")).count() > 0  # they are estimates


def test_within_sees_a_wrong_estimate(spark):
    df = spark.createDataFrame([(1000, 1000), (1500, 1000), (0, 3), (3, 3)], "e long, x long")
    assert [r[0] for r in df.select(sketches.within("e", "x")).collect()] == [True, False, False, True]


def test_city_counts_by_sketches_have_the_exact_groups(t):
    for exact, sketched, key in ((cities.city_counts_left, sketches.city_counts_sketched, "City"),
                                 (cities.city_conditional_distinct, sketches.city_conditional_sketched, "city")):
        a, b = exact(t), sketched(t)
        assert a.columns == b.columns and a.dtypes == b.dtypes
        assert {r[key] for r in a.collect()} == {r[key] for r in b.collect()}


def small(spark, claims):
    return Tables(spark.createDataFrame([], PROVIDERS), spark.createDataFrame([], RECEIVERS),
                  spark.createDataFrame([(1, "x", 1, None, 10, "t", "Goa", "f", "m"), (2, "y", 1, None, 11, "t", None, "f", "m"),
                                         (3, "z", 1, None, None, "t", "Goa", "f", "m")], FOOD_LISTINGS),
                  spark.createDataFrame(claims, CLAIMS))


def test_nulls_are_groups_but_not_counted(spark):
    day = dt.datetime(2025, 3, 5, 9)
    t = small(spark, [(1, 1, 7, "Pending", day), (2, 1, None, "Pending", day), (3, 3, 7, "Pending", None),
                      (4, 2, 8, "Pending", day), (5, None, 8, "Pending", day)])
    got = {(r["City"], r["Day"]): (r["receivers"], r["listings"], r["providers"])
           for r in sketches.estimates(sketches.activity_sketches(t)).collect()}
    assert got == {("Goa", day.date()): (1, 1, 1), ("Goa", None): (1, 1, 0), (None, day.date()): (1, 1, 1)}
    assert sketches.activity_sketches(small(spark, [])).count() == 0


def test_loads_merge_and_days_are_replaced(spark, tmp_path):
    one, two = dt.datetime(2025, 3, 5, 9), dt.datetime(2025, 3, 6, 9)
    first = small(spark, [(1, 1, 7, "Pending", one), (2, 1, 8, "Pending", two)])
    late = small(spark, [(3, 1, 9, "Pending", one), (4, 1, 7, "Pending", one)])
    for k in (first, late):
        sketches.add_sketches(sketches.activity_sketches(k), f"{tmp_path}/loads")

    def days(path):
        return {r["Day"].day: r["receivers"] for r in sketches.estimates(sketches.load_sketches(spark, path)).collect()}

    assert days(f"{tmp_path}/loads") == {5: 2, 6: 1}
    sketches.compact_sketches(spark, f"{tmp_path}/loads", f"{tmp_path}/days")
    assert days(f"{tmp_path}/days") == {5: 2, 6: 1}
    assert spark.read.parquet(f"{tmp_path}/days").count() == 2
    reach = sketches.reach(sketches.load_sketches(spark, f"{tmp_path}/days")).collect()
    assert [(r["City"], r["Period"], r["receivers"]) for r in reach] == [("Goa", dt.date(2025, 3, 1), 3)]
    # Receiver 9's claim is deleted: its day is sketched anew.
    left = small(spark, [(1, 1, 7, "Pending", one), (4, 1, 7, "Pending", one)])
    fresh = sketches.activity_sketches(left)
    sketches.replace_days(spark, f"{tmp_path}/days", f"{tmp_path}/after", fresh.select("Day"), fresh)
    assert days(f"{tmp_path}/after") == {5: 1, 6: 1}


def test_partial_sketches_are_built_before_the_shuffle(t):
    p = sketches.sketch_by(t.receivers, ["City"], {"n": "Receiver_ID"})._jdf.queryExecution().executedPlan().toString()
    assert "partial_hll_sketch_agg" in p


def test_exact_reach_keeps_a_bounded_number_of_claims_a_task(edge, monkeypatch):
    from gleaner.plans import approx

    tables = edge[0]
    want = sorted(map(tuple, approx.monthly_reach_sketched(tables).collect()), key=repr)
    monkeypatch.setattr(approx, "ROWS_PER_TASK", 2)
    kind, dealt = type(tables.claims), []
    real = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda df, n, *c: (dealt.append(n), real(df, n, *c))[1])
    assert sorted(map(tuple, approx.monthly_reach_sketched(tables).collect()), key=repr) == want
    assert dealt == [1 + tables.claims.count() // 2]
