"""Search (regex, case, NULL cells), dashboard filters, contact links."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from gleaner.operators import search


def ids(df, col="Food_ID"):
    return sorted(r[col] for r in df.collect())


def test_blank_search_returns_everything(edge):
    t, _ = edge
    assert search.search_listings(t, "   ").count() == t.listings.count()


def test_search_is_case_insensitive_over_three_columns(edge):
    t, _ = edge
    assert ids(search.search_listings(t, "RICE")) == [10, 11]
    assert ids(search.search_listings(t, "household")) == [11, 15]
    assert ids(search.search_listings(t, "mum")) == [11, 15]


def test_search_is_a_regex_and_null_cells_do_not_match(edge):
    t, _ = edge
    assert ids(search.search_listings(t, "^(bread|soup)$")) == [12, 13]
    # Listing 13 has a NULL Location: it only matches through its name.
    assert ids(search.search_listings(t, "business|delhi")) == [10, 12, 13, 14, 16, 17]


def test_literal_search_escapes_regex_characters(edge):
    t, _ = edge
    got = search.search_contacts(t, "(a.b)*", literal=True)
    assert [r["Name"] for r in got.collect()] == ["Dev (a.b)*"]


def test_invalid_regex_raises(edge):
    t, _ = edge
    with pytest.raises((PySparkException, Py4JJavaError)):
        search.search_contacts(t, "(unclosed").collect()


def test_contact_search_by_city_or_name(edge):
    t, _ = edge
    got = search.search_contacts(t, "pune|bina")
    assert sorted(r["Provider_ID"] for r in got.collect()) == [3, 4]
    assert got.columns == ["Provider_ID", "Name", "Type", "City", "Contact"]


def test_filters_all_means_off_and_combine(edge):
    t, _ = edge
    assert search.filter_listings(t, "All", "All", "All").count() == t.listings.count()
    assert ids(search.filter_listings(t, location="Delhi", food_type="Veg")) == [10, 12, 16, 17]


def test_provider_name_picks_first_id_of_namesakes(edge):
    t, _ = edge
    # Two providers are called Asha (ids 1 and 2); only id 1 is used.
    assert ids(search.filter_listings(t, provider_name="Asha")) == [10, 12]
    assert search.filter_listings(t, provider_name="Nobody").count() == 0


def test_filter_options_sorted_distinct_without_null(edge):
    t, _ = edge
    assert [r[0] for r in search.location_options(t).collect()] == ["Delhi", "Mumbai"]
    assert [r[0] for r in search.food_type_options(t).collect()] == ["Non-Veg", "Veg"]
    assert [r[0] for r in search.provider_name_options(t).collect()] == [
        "Asha", "Bina", "Chand", "Dev (a.b)*"]


def test_providers_in_view_with_mailto_links(edge):
    t, _ = edge
    view = search.filter_listings(t, location="Mumbai")
    got = {r["Provider_ID"]: r for r in search.providers_in_view(t, view).collect()}
    assert list(got) == [2]
    assert got[2]["Contact_Link"] == "98765 43210"
    delhi = {r["Provider_ID"]: r["Contact_Link"]
             for r in search.contacts_in_view(t, location="Delhi").collect()}
    assert delhi == {1: "mailto:asha@example.org", 5: "mailto:dev@food.in"}


def test_row_count(edge):
    t, _ = edge
    assert search.row_count(search.search_listings(t, "rice")) == 2


def test_search_folds_letters_of_all_scripts(spark):
    from pyspark.sql import functions as F

    from gleaner.functions import matches_any

    df = spark.createDataFrame([("CAFÉ MÜLLER",), ("café",), ("cafe",), (None,)], "Name string")
    for literal in (False, True):
        assert df.where(matches_any(["Name"], "café", literal)).count() == 2
    assert df.where(matches_any(["Name"], "m[üx]ller")).count() == 1
    del F
