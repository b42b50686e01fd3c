"""Shared helpers: grouping, ranking with ties, shares, search predicates, dates."""

import datetime as D

from pyspark.sql import functions as F

from gleaner.functions import as_of_date, count_by, matches_any, share_of_total, topk


def test_count_by_keeps_a_null_group(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",), (None,), ("b",)], "k string")
    got = {r["k"]: r["n"] for r in count_by(df, "k", "n").collect()}
    assert got == {"a": 2, None: 2, "b": 1}


def test_topk_breaks_ties_by_keys_ascending(spark):
    df = spark.createDataFrame([("d", 2), ("c", 2), ("b", 5), ("a", 2), (None, 2)], "k string, m long")
    assert [r["k"] for r in topk(df, "m", 3, ["k"]).collect()] == ["b", None, "a"]


def test_topk_puts_null_measures_last(spark):
    df = spark.createDataFrame([("a", None), ("b", 1)], "k string, m long")
    assert [r["k"] for r in topk(df, "m", 2, ["k"]).collect()] == ["b", "a"]


def test_share_of_total(spark):
    df = spark.createDataFrame([("x", 1), ("y", 3)], "k string, n long")
    got = {r["k"]: r["pct"] for r in share_of_total(df, "n", "pct").collect()}
    assert got == {"x": 25.0, "y": 75.0}


def test_share_of_empty_input_never_divides(spark):
    df = spark.createDataFrame([], "k string, n long")
    assert share_of_total(df, "n", "pct").collect() == []


def test_matches_any_regex_literal_and_null(spark):
    df = spark.createDataFrame([("Rice (1kg)", None), ("bread", "Pune"), (None, None)], "a string, b string")
    regex = [r["a"] for r in df.where(matches_any(["a", "b"], "^RICE|pune")).collect()]
    literal = [r["a"] for r in df.where(matches_any(["a", "b"], "(1KG)", literal=True)).collect()]
    assert regex == ["Rice (1kg)", "bread"] and literal == ["Rice (1kg)"]


def test_as_of_date(spark):
    row = spark.range(1).select(as_of_date("2025-03-17").alias("d"), as_of_date(None).alias("t"),
                                F.current_date().alias("c")).first()
    assert row["d"] == D.date(2025, 3, 17) and row["t"] == row["c"]
