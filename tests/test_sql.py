"""User SQL over the registered tables, with named and positional parameters."""

from gleaner.plans.sql import run_sql


def test_named_parameter(spark, edge):
    t, _ = edge
    df = run_sql(spark, t, "SELECT Name, Contact, Address FROM providers WHERE City = :city",
                 {"city": "Delhi"})
    assert sorted(r["Name"] for r in df.collect()) == ["Asha", "Dev (a.b)*"]


def test_positional_parameter_and_case_insensitive_names(spark, edge):
    t, _ = edge
    df = run_sql(spark, t, "SELECT COUNT(*) AS n FROM Claims c JOIN Food_Listings f "
                           "ON c.Food_ID = f.Food_ID WHERE f.Food_Type = ?", ["Veg"])
    assert df.first()["n"] == 5  # claims 100, 101, 104 and both on listing 16


def test_parameter_is_not_spliced(spark, edge):
    t, _ = edge
    df = run_sql(spark, t, "SELECT * FROM providers WHERE City = :city", {"city": "x' OR '1'='1"})
    assert df.count() == 0
