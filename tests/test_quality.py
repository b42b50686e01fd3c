"""Domain rules, dangling references and duplicate keys on the edge tables."""

from gleaner.operators import quality


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_domain_violations(edge):
    t, _ = edge
    got = rows(quality.domain_violations(t), "table_name", "row_key", "bad_value")
    assert got == [("claims", 100, "Done")]


def test_quantity_zero_is_allowed_negative_is_not(spark, edge):
    t, _ = edge
    from gleaner.tables import Tables
    neg = t.listings.limit(1).selectExpr("Food_ID", "Food_Name", "-1L AS Quantity", "Expiry_Date",
                                         "Provider_ID", "Provider_Type", "Location", "Food_Type",
                                         "Meal_Type")
    t2 = Tables(t.providers, t.receivers, t.listings.unionByName(neg), t.claims)
    got = rows(quality.domain_violations(t2).where("rule LIKE 'Quantity%'"), "bad_value")
    assert got == [("-1",)]


def test_orphan_claim(edge):
    t, _ = edge
    got = rows(quality.orphan_references(t), "table_name", "fk_column", "row_key", "ref_value")
    assert got == [("claims", "Food_ID", 107, 99)]


def test_duplicate_keys(edge):
    t, _ = edge
    got = rows(quality.duplicate_keys_all(t), "table_name", "row_key", "copies")
    assert got == [("claims", 100, 2)]
