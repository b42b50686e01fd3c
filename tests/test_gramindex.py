"""Trigram signatures: rows equal the scan's, files are skipped, patterns that say nothing skip none."""

import random

import pytest

from gleaner.functions import matches_any
from gleaner.sources import gramindex
from tests.test_changes_bruteforce import sorted_rows

COLUMNS = ["Name", "City"]
SCHEMA = "id long, Name string, City string"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = []
    for k in range(600):
        name = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(0, 9)))
        rows.append((k, rng.choice([name, name.upper(), None, name + " Ltd."]), rng.choice(["Pune", "Goa", "München", None])))
    rows += [(1000, "Straſe Kitchen", "Goa"), (1001, "marKet", None), (1002, "İstanbul kıtchen", ""),
             (1003, "A.B", "x"), (1004, "CafÉ rice", "Goa"), (1005, "a+b|c", "Goa"), (1006, "line\nbreak", "Goa")]
    df = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path_factory.mktemp("grams") / "with space")
    gramindex.store(df, path, COLUMNS, files=12)
    return df, path


PATTERNS = ["ltd", "LTD", "kitchen", "market", "istanbul", "strasse", "stra.e kit", "café rice", "caf. rice", "pune|goa",
            "^abc", "xyz$", "ab", "a.c", "", "  ", "(abc|pune)", "[lL]td", "ltd?", "lt+d", "ltd{0,2}", r"ltd\.", r"a\.b",
            r"\bLtd\b", "(?i)goa", r"\Qa+b|c\E", r"a\+b\|c", "rice.*", "qqqqqqqq", "mün", "MÜNCHEN", "line\nbreak", "l(i)ne",
            "zz|ltd", "[]a]bc|ltd", "[^x]itchen", "kit(?:chen)", "ric(e)?", "x*pune", "a{2}ltd|goa", "ſtra"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_rows_equal_the_scan(spark, stored, pattern):
    df, path = stored
    want = df if not pattern.strip() else df.where(matches_any(COLUMNS, pattern))
    got = gramindex.search(spark, path, df.schema, COLUMNS, pattern)
    assert sorted_rows(map(tuple, got.collect())) == sorted_rows(map(tuple, want.collect()))


@pytest.mark.parametrize("text", ["ltd.", "a+b|c", "CAFÉ r", "market", "(abc", "pu", "istanbul"])
def test_plain_text_equals_the_scan(spark, stored, text):
    df, path = stored
    got = gramindex.search(spark, path, df.schema, COLUMNS, text, literal=True)
    want = df.where(matches_any(COLUMNS, text, literal=True))
    assert sorted_rows(map(tuple, got.collect())) == sorted_rows(map(tuple, want.collect()))


def test_files_without_the_trigrams_are_not_read(spark, stored):
    df, path = stored
    files, total = gramindex.files_to_read(spark, path, "kitchen")
    assert 1 <= len(files) <= 4 < total >= 10
    assert len(gramindex.search(spark, path, df.schema, COLUMNS, "kitchen").inputFiles()) == len(files)
    assert gramindex.files_to_read(spark, path, "qqqqqqqq|vvvvvvvv")[0] == []
    for pattern in ("ab", "kitchen|a", "(?i)kitchen", "(kitchen)"):  # nothing, or not for every alternative
        assert len(gramindex.files_to_read(spark, path, pattern)[0]) == total


def test_runs_that_every_match_holds():
    runs = {p: gramindex.literal_runs(p) for p in PATTERNS}
    kept = {p: [[r for r in b if r] for b in (runs[p] or [])] for p in PATTERNS}
    assert kept["stra.e kit"] == [["stra", "e kit"]] and kept["pune|goa"] == [["pune"], ["goa"]]
    assert kept["ltd?"] == [["lt"]] and kept["lt+d"] == [["lt", "d"]] and kept["ltd{0,2}"] == [["lt"]]
    assert kept[r"a\+b\|c"] == [["a+b|c"]] and kept[r"\bLtd\b"] == [["Ltd"]] and kept["x*pune"] == [["pune"]]
    assert kept["(abc|pune)"] == [[]] and kept["[^x]itchen"] == [["itchen"]] and kept["ric(e)?"] == [["ric"]]
    assert runs["(?i)goa"] is None and runs[r"\Qa+b|c\E"] is None and runs["kit(?:chen)"] is None


def test_empty_tables_are_searched(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    gramindex.store(df, str(tmp_path / "e"), COLUMNS, files=2)
    assert gramindex.search(spark, str(tmp_path / "e"), df.schema, COLUMNS, "kitchen").count() == 0
    assert gramindex.search(spark, str(tmp_path / "e"), df.schema, COLUMNS, "").count() == 0
