"""Inserts, updates (including to NULL), deletes and their fold by seq."""

import datetime as D

import pytest

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gleaner.operators import changes
from gleaner.schema import PROVIDERS, change_schema
from tests.fixtures import PROVIDER_ROWS


def providers(spark, rows=PROVIDER_ROWS):
    return spark.createDataFrame(rows, PROVIDERS)


def change_rows(spark, rows):
    """rows: (op, seq, Provider_ID, Name, Type, Address, City, Contact, set_columns)."""
    return spark.createDataFrame(rows, change_schema("providers"))


def as_dict(df):
    return {r["Provider_ID"]: r.asDict() for r in df.collect()}


def test_append_assigns_next_ids_in_order(spark):
    base = providers(spark)
    new = spark.createDataFrame(
        [(None, f"N{i}", "Other", None, "Goa", None) for i in range(25)], PROVIDERS
    ).withColumn("ord", F.monotonically_increasing_id()).repartition(4)
    out = changes.append_rows(base, new.drop("ord"), "Provider_ID")
    ids = sorted(r["Provider_ID"] for r in out.collect())
    assert ids == [1, 2, 3, 4, 5] + list(range(6, 31))


def test_append_on_empty_table_starts_at_one(spark):
    empty = spark.createDataFrame([], PROVIDERS)
    new = spark.createDataFrame([(None, "A", "Other", None, "Goa", None),
                                 (None, "B", "Other", None, "Goa", None)], PROVIDERS)
    assert sorted(r[0] for r in changes.append_rows(empty, new, "Provider_ID").collect()) == [1, 2]


def test_assign_ids_follow_order_column(spark):
    rows = [(None, f"N{i}", "Other", None, "Goa", None, 100 - i) for i in range(40)]
    schema = StructType(PROVIDERS.fields + [StructField("seq", LongType())])
    df = spark.createDataFrame(rows, schema).repartition(5)
    out = changes.assign_ids(df, "Provider_ID", F.lit(10).cast("long"), ["seq"])
    got = {r["seq"]: r["Provider_ID"] for r in out.collect()}
    assert [got[s] for s in sorted(got)] == list(range(11, 51))


def test_delete_removes_every_row_with_key(spark):
    dup = PROVIDER_ROWS + [(2, "Asha copy", "Other", None, "Goa", None)]
    out = changes.apply_deletes(providers(spark, dup), spark.createDataFrame([(2,)], "Provider_ID long"),
                                "Provider_ID")
    assert sorted(r[0] for r in out.collect()) == [1, 3, 4, 5]


def test_update_sets_listed_columns_only_and_null_explicitly(spark):
    upd = change_rows(spark, [
        ("update", 1, 1, "Asha K", None, None, None, None, ["Name", "Contact"]),
        ("update", 2, 1, None, None, None, "Noida", None, ["City"]),
        ("update", 3, 5, "ignored", None, None, None, None, []),
    ])
    out = as_dict(changes.apply_updates(providers(spark), upd, "Provider_ID"))
    assert out[1]["Name"] == "Asha K" and out[1]["Contact"] is None and out[1]["City"] == "Noida"
    assert out[1]["Type"] == "Restaurant" and out[1]["Address"] == "12 Main St"
    assert out[5] == dict(zip(PROVIDERS.names, PROVIDER_ROWS[4]))


def test_later_update_wins_per_column(spark):
    upd = change_rows(spark, [
        ("update", 5, 2, "Late", None, None, None, None, ["Name"]),
        ("update", 3, 2, "Early", "X", None, None, None, ["Name", "Type"]),
    ])
    out = as_dict(changes.apply_changes(providers(spark), upd, "Provider_ID"))
    assert out[2]["Name"] == "Late" and out[2]["Type"] == "X"


def test_insert_update_to_null_then_delete_on_one_key(spark):
    ch = change_rows(spark, [
        ("insert", 1, 9, "Nina", "NGO", "Road 1", "Goa", "n@x.org", None),
        ("update", 2, 9, None, None, None, None, None, ["Contact"]),
        ("delete", 3, 9, None, None, None, None, None, None),
    ])
    out = as_dict(changes.apply_changes(providers(spark), ch, "Provider_ID"))
    assert 9 not in out and len(out) == 5
    # Without the delete, the insert survives with Contact set to NULL.
    out = as_dict(changes.apply_changes(providers(spark), ch.where("seq < 3"), "Provider_ID"))
    assert out[9]["Contact"] is None and out[9]["Name"] == "Nina"


def test_update_before_insert_does_not_touch_the_inserted_row(spark):
    ch = change_rows(spark, [
        ("update", 1, 1, "Renamed", None, None, None, None, ["Name"]),
        ("delete", 2, 1, None, None, None, None, None, None),
        ("insert", 3, 1, "Fresh", "Other", None, "Goa", None, None),
        ("update", 4, 1, None, None, None, "Agra", None, ["City"]),
    ])
    out = as_dict(changes.apply_changes(providers(spark), ch, "Provider_ID"))
    assert out[1]["Name"] == "Fresh" and out[1]["City"] == "Agra"


def test_keyless_inserts_get_ids_in_statement_order(spark):
    ch = change_rows(spark, [
        ("insert", 2, None, "Second", "Other", None, "Goa", None, None),
        ("insert", 1, None, "First", "Other", None, "Goa", None, None),
        ("delete", 3, 5, None, None, None, None, None, None),
    ])
    out = as_dict(changes.apply_changes(providers(spark), ch, "Provider_ID"))
    # 5 is the highest id while they are inserted; it is deleted later.
    assert out[6]["Name"] == "First" and out[7]["Name"] == "Second" and 5 not in out


def test_later_changes_reach_a_row_that_got_its_id_in_the_batch(spark):
    base = spark.createDataFrame([(9, "a", None, None, None, None), (10, "b", None, None, None, None)], PROVIDERS)
    ch = change_rows(spark, [
        ("insert", 1, None, "new", None, None, None, None, None),
        ("delete", 2, 10, None, None, None, None, None, None),
        ("update", 3, 11, "renamed", None, None, None, None, ["Name"]),
    ])
    out = as_dict(changes.apply_changes(base, ch, "Provider_ID"))
    assert set(out) == {9, 11} and out[11]["Name"] == "renamed"


def test_a_freed_highest_id_is_given_again(spark):
    base = spark.createDataFrame([(9, "a", None, None, None, None), (10, "b", None, None, None, None)], PROVIDERS)
    ch = change_rows(spark, [
        ("delete", 1, 10, None, None, None, None, None, None),
        ("insert", 2, None, "new", None, None, None, None, None),
    ])
    assert as_dict(changes.apply_changes(base, ch, "Provider_ID"))[10]["Name"] == "new"


def test_an_id_deleted_between_keyless_inserts_is_given_again(spark):
    top = max(r["Provider_ID"] for r in providers(spark).collect())
    ch = change_rows(spark, [
        ("insert", 1, None, "x", None, None, None, None, None),
        ("delete", 2, top + 1, None, None, None, None, None, None),
        ("insert", 3, None, "y", None, None, None, None, None),
    ])
    out = as_dict(changes.apply_changes(providers(spark), ch, "Provider_ID"))
    assert out[top + 1]["Name"] == "y" and top + 2 not in out


def test_batches_without_a_defined_result_are_refused(spark):
    twice = change_rows(spark, [
        ("update", 1, 1, "x", None, None, None, None, ["Name"]),
        ("update", 1, 1, "y", None, None, None, None, ["Name"]),
    ])
    with pytest.raises(ValueError, match="share a seq"):
        changes.apply_changes(providers(spark), twice, "Provider_ID")


def test_hot_key_fold_is_aggregated_not_windowed(spark):
    many = [("update", i, 1, f"v{i}", None, None, None, None, ["Name"]) for i in range(500)]
    ch = change_rows(spark, many)
    fold = changes._fold(ch, "Provider_ID", ["Name", "Type", "Address", "City", "Contact"])
    plan = fold._jdf.queryExecution().executedPlan().toString()
    # Map-side partial aggregation: a hot key is combined before the shuffle.
    assert "partial_max_by" in plan and "Window" not in plan
    out = changes.apply_changes(providers(spark), ch, "Provider_ID")
    assert as_dict(out)[1]["Name"] == "v499"


def test_dates_survive_the_fold(spark):
    from gleaner.schema import FOOD_LISTINGS
    from tests.fixtures import LISTING_ROWS
    base = spark.createDataFrame(LISTING_ROWS, FOOD_LISTINGS)
    ch = spark.createDataFrame(
        [("update", 1, 10, None, None, D.date(2030, 1, 1), None, None, None, None, None, ["Expiry_Date"])],
        change_schema("food_listings"))
    out = {r["Food_ID"]: r for r in changes.apply_changes(base, ch, "Food_ID").collect()}
    assert out[10]["Expiry_Date"] == D.date(2030, 1, 1) and out[11]["Expiry_Date"] == LISTING_ROWS[1][3]


def test_claim_inserts_are_stamped_with_local_time(spark):
    from gleaner.schema import CLAIMS
    base = spark.createDataFrame([], CLAIMS)
    ch = spark.createDataFrame([
        ("insert", 1, 1, 5, 2, "Pending", None, None),
        ("insert", 2, 2, 5, 2, "Pending", D.datetime(2025, 3, 1, 9, 0), None),
    ], change_schema("claims"))
    out = {r["Claim_ID"]: r["Timestamp"] for r in
           changes.apply_changes(base, changes.stamp_inserts(ch), "Claim_ID").collect()}
    assert out[2] == D.datetime(2025, 3, 1, 9, 0)
    assert out[1] is not None and abs((out[1] - D.datetime.now()).total_seconds()) < 24 * 3600
    assert out[1].tzinfo is None


def test_a_third_of_identical_copies_is_split_across_sort_partitions(spark):
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = [(None, "Same", "NGO", None, "Goa", None)] * 3000 + \
               [(None, f"N{i}", "NGO", None, "Goa", None) for i in range(6000)]
        df = spark.createDataFrame(rows, PROVIDERS).repartition(8)
        out = changes.assign_ids(df, "Provider_ID", F.lit(0).cast("long"), ["Name", "City"])
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        ids = sorted(r["Provider_ID"] for r in out.select("Provider_ID").collect())
        assert ids == list(range(1, 9001))
        assert max(sizes) < 3000  # the 3,000 copies did not land in one partition
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_updatable_limits_the_columns_an_update_may_set(spark):
    upd = change_rows(spark, [("update", 1, 1, "X", "Y", None, "Z", None, ["Name", "City"])])
    out = as_dict(changes.apply_updates(providers(spark), upd, "Provider_ID", updatable=["City"]))
    assert out[1]["City"] == "Z" and out[1]["Name"] == "Asha"


def test_fold_of_a_numeric_column_is_a_hash_aggregate(spark):
    ch = spark.createDataFrame(
        [("update", 1, 10, None, 3, None, None, None, None, None, None, ["Quantity"])],
        change_schema("food_listings"))
    plan = changes._fold(ch, "Food_ID", ["Quantity"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
