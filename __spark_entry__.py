"""

Every query reads the driver's parquet tables through the role views of
``gleaner.sources.roles`` (FIXTURES.md section 2); every oracle runs the same
role mapping as DuckDB CTEs, followed by SQL written from the query's definition
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# The package lives next to this file; make it importable however this module is loaded.
_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from gleaner import schema  # noqa: E402
from gleaner.operators.quality import DOMAIN_RULES  # noqa: E402
from gleaner.plans.catalog import CATALOGUE  # noqa: E402
from gleaner.sources import roles  # noqa: E402

# Operators for training-data corpora; the rest works without them.
try:
    from gleaner.llm.queries import ORACLES as LLM_ORACLES, QUERIES as LLM_QUERIES  # noqa: E402
    import corpus_pipeline  # noqa: E402
except ModuleNotFoundError as missing:
    if not (missing.name or "").startswith(("gleaner.llm", "corpus_pipeline")):
        raise
    LLM_ORACLES, LLM_QUERIES = {}, {}
else:
    LLM_QUERIES = LLM_QUERIES | {"pipeline": corpus_pipeline.run}
    if corpus_pipeline.ORACLE_SQL:
        LLM_ORACLES = LLM_ORACLES | {"pipeline": corpus_pipeline.ORACLE_SQL}

FLAGSHIP = "wasted_quantity_by_location"
SMOKE_DIR = "/root/testdata/sf0.001"

# Parameters of the registered queries on the role mapping.
PARAMS = {
    "as_of": roles.AS_OF,
    "city": roles.CITY,
    "food_type": roles.FOOD_TYPE,
    "listing_pattern": "urgent|nation_2|^build",
    "contact_pattern": "nation_1$|#00000000[1-3]",
    "provider_name": "Customer#000000001",
}


def _query(key: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return CATALOGUE[key](roles.role_tables(spark, sf_dir), **PARAMS)
    run.__name__ = key
    return run


def entry(spark: SparkSession) -> DataFrame:
    return _query(FLAGSHIP)(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: _query(key) for key in CATALOGUE} | LLM_QUERIES


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in_list(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _domain_sql() -> str:
    parts = []
    for table, rule, column, kind, arg in DOMAIN_RULES:
        bad = f"{column} NOT IN {_in_list(arg)}" if kind == "in" else f"{column} < {arg}"
        parts.append(f"SELECT {_q(table)} AS table_name, {_q(rule)} AS rule, "
                     f"{schema.KEYS[table]} AS row_key, CAST({column} AS VARCHAR) AS bad_value "
                     f"FROM {table} WHERE {column} IS NOT NULL AND {bad}")
    return "\nUNION ALL\n".join(parts)


def _orphans_sql() -> str:
    parts = []
    for table, column, parent in schema.REFERENCES:
        pk = schema.KEYS[parent]
        parts.append(f"SELECT {_q(table)} AS table_name, {_q(column)} AS fk_column, "
                     f"x.{schema.KEYS[table]} AS row_key, x.{column} AS ref_value FROM {table} x "
                     f"WHERE x.{column} IS NOT NULL AND NOT EXISTS "
                     f"(SELECT 1 FROM {parent} y WHERE y.{pk} = x.{column})")
    return "\nUNION ALL\n".join(parts)


def _duplicates_sql() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {_q(t)} AS table_name, {k} AS row_key, COUNT(*) AS copies FROM {t} "
        f"GROUP BY {k} HAVING COUNT(*) > 1" for t, k in schema.KEYS.items())


def _unexpired(as_of: str) -> str:
    """Listings of ids that no expired listing has."""
    return ("(SELECT * FROM food_listings f WHERE f.Food_ID IS NULL OR f.Food_ID NOT IN "
            f"(SELECT Food_ID FROM food_listings WHERE Expiry_Date < {as_of} AND Food_ID IS NOT NULL))")


def _settled_sql(listings: str) -> str:
    """Listings with Quantity := MIN(Quantity) of the key - completed claims, where claimed."""
    return ("SELECT l.Food_ID, l.Food_Name, CASE WHEN d.done IS NULL THEN l.Quantity "
            "ELSE q.min_q - d.done END AS Quantity, l.Expiry_Date, l.Provider_ID, l.Provider_Type, "
            f"l.Location, l.Food_Type, l.Meal_Type FROM {listings} l "
            "LEFT JOIN (SELECT Food_ID, MIN(Quantity) AS min_q FROM food_listings GROUP BY Food_ID) q "
            "ON l.Food_ID = q.Food_ID "
            "LEFT JOIN (SELECT Food_ID, COUNT(Claim_ID) AS done FROM claims WHERE Status = 'Completed' "
            "GROUP BY Food_ID) d ON l.Food_ID = d.Food_ID")


def _matches(columns, pattern: str) -> str:
    """Whether any of the cells matches, ignoring case; NULL cells never do."""
    return f"len(list_filter([{', '.join(columns)}], lambda cell: regexp_matches(cell, {_q(pattern)}, 'i'))) > 0"


def _counts(table: str, keys: str, alias: str) -> str:
    """Rows per group, as a window over the rows."""
    return f"SELECT DISTINCT {keys}, COUNT(*) OVER (PARTITION BY {keys}) AS {alias} FROM {table}"


def _first(k: int, measure: str, keys: str, body: str) -> str:
    """The ``k`` rows of ``body`` with the largest measure (NULL last), ties by the keys (NULL first)."""
    order = ", ".join(f"{key} ASC NULLS FIRST" for key in keys.split(", "))
    return (f"SELECT * FROM ({body}) QUALIFY ROW_NUMBER() OVER (ORDER BY {measure} DESC NULLS LAST, {order}) <= {k}")


# Building blocks: one row per key, so that no oracle joins the fact tables row by row before it must.
CLAIMS_OF_FOOD = "(SELECT Food_ID, COUNT(Claim_ID) AS n FROM claims GROUP BY Food_ID)"
CLAIMS_OF_RECEIVER = "(SELECT Receiver_ID, COUNT(Claim_ID) AS n FROM claims GROUP BY Receiver_ID)"
DONE_OF_FOOD = ("(SELECT Food_ID, COUNT(Claim_ID) FILTER (WHERE Status = 'Completed') AS n FROM claims "
                "GROUP BY Food_ID)")
SUPPLY_OF_PROVIDER = ("(SELECT Provider_ID, COUNT(Food_ID) AS n, SUM(Quantity) AS q FROM food_listings "
                      "GROUP BY Provider_ID)")


#: Claims once the cancelled are deleted and the pending completed, each by its id.
CLAIMS_COMPLETED = (
    "(SELECT Claim_ID, Food_ID, Receiver_ID, CASE WHEN Claim_ID IN (SELECT Claim_ID FROM claims "
    "WHERE Status = 'Pending') THEN 'Completed' ELSE Status END AS Status FROM claims WHERE Claim_ID IS NULL OR "
    "Claim_ID NOT IN (SELECT Claim_ID FROM claims WHERE Status = 'Cancelled' AND Claim_ID IS NOT NULL))")


def _claims_by_listing(column: str, alias: str, name: str | None = None) -> str:
    """Claims per value of a listing column, from the claims per Food_ID."""
    return (f"SELECT l.{column} AS {name or column}, CAST(SUM(k.n) AS BIGINT) AS {alias} "
            f"FROM {CLAIMS_OF_FOOD} k, food_listings l WHERE l.Food_ID = k.Food_ID GROUP BY l.{column}")


def _claims_of_listings(condition: str, alias: str, name: str = "Name") -> str:
    """Claims per receiver name, of the listings that meet a condition (a Food_ID listed m times counts m times)."""
    listed = f"(SELECT Food_ID, COUNT(*) AS m FROM food_listings WHERE {condition} GROUP BY Food_ID)"
    per = (f"(SELECT c.Receiver_ID, SUM(CASE WHEN c.Claim_ID IS NULL THEN 0 ELSE x.m END) AS n "
           f"FROM claims c, {listed} x WHERE x.Food_ID = c.Food_ID GROUP BY c.Receiver_ID)")
    return (f"SELECT r.Name AS {name}, CAST(SUM(y.n) AS BIGINT) AS {alias} FROM {per} y, receivers r "
            f"WHERE r.Receiver_ID = y.Receiver_ID GROUP BY r.Name")


def oracle_bodies(params: dict | None = None) -> dict[str, str]:
    """The oracle queries over tables named providers, receivers, food_listings, claims.

    """
    params = params or PARAMS
    as_of = f"DATE {_q(str(params['as_of']))}"
    city, ft = _q(params["city"]), _q(params["food_type"])
    listing_cols = "Food_Name, Location, Provider_Type".split(", ")
    overdue = f"date_diff('day', Expiry_Date, {as_of}) > 0"
    return {
        # Rows of one table.
        "providers_all": "SELECT Provider_ID, Name, Type, Address, City, Contact FROM providers",
        "receivers_all": "SELECT Receiver_ID, Name, Type, City, Contact FROM receivers",
        "providers_in_city": f"SELECT * FROM providers WHERE City IN ({city})",
        "receivers_in_city": f"SELECT * FROM receivers WHERE City IN ({city})",
        "provider_contacts_in_city":
            f"SELECT who.Name, who.Contact, who.Address FROM (SELECT * FROM providers WHERE City IN ({city})) who",
        "expiring_within":
            f"SELECT * FROM food_listings WHERE date_diff('day', {as_of}, Expiry_Date) <= 3",
        "expired_listings": f"SELECT Food_Name, Expiry_Date FROM food_listings WHERE {overdue}",
        # One table, grouped.
        "total_quantity":
            "SELECT CAST(SUM(part) AS BIGINT) AS total_quantity FROM "
            "(SELECT SUM(Quantity) AS part FROM food_listings GROUP BY Provider_ID)",
        "avg_quantity":
            "SELECT CAST(SUM(Quantity) AS DOUBLE) / NULLIF(COUNT(Quantity), 0) AS avg_quantity FROM food_listings",
        "listings_by_food_type": _counts("food_listings", "Food_Type", "Count"),
        "listings_by_meal_type": _counts("food_listings", "Meal_Type", "Count"),
        "listings_by_provider_type": _counts("food_listings", "Provider_Type", "num_listings"),
        "avg_quantity_by_provider_type":
            "SELECT Provider_Type, CAST(SUM(Quantity) AS DOUBLE) / NULLIF(COUNT(Quantity), 0) AS avg_quantity "
            "FROM food_listings GROUP BY Provider_Type",
        "quantity_by_location":
            "SELECT DISTINCT Location, CAST(SUM(Quantity) OVER (PARTITION BY Location) AS BIGINT) AS total_quantity "
            "FROM food_listings",
        "meals_by_city": _counts("(SELECT Location AS City, Meal_Type FROM food_listings)", "City, Meal_Type", "Count"),
        "top_provider_type_by_listings":
            _first(1, "Total_Listings", "Provider_Type", _counts("food_listings", "Provider_Type", "Total_Listings")),
        "top_locations_by_listings":
            _first(5, "Total_Listings", "City",
                   _counts("(SELECT Location AS City FROM food_listings)", "City", "Total_Listings")),
        "city_with_most_listings":
            _first(1, "Total_Listings", "City",
                   _counts("(SELECT Location AS City FROM food_listings)", "City", "Total_Listings")),
        "top_meal_type": _first(1, "Count", "Meal_Type", _counts("food_listings", "Meal_Type", "Count")),
        "top_food_names": _first(5, "Times_Listed", "Food_Name", _counts("food_listings", "Food_Name", "Times_Listed")),
        "food_type_distribution":
            "SELECT DISTINCT Food_Type, COUNT(*) OVER (PARTITION BY Food_Type) AS Count, "
            "ROUND(CAST(COUNT(*) OVER (PARTITION BY Food_Type) AS DOUBLE) * 100.0 / COUNT(*) OVER (), 1) "
            "AS Percentage FROM (SELECT Food_Type FROM food_listings WHERE Food_Type IS NOT NULL)",
        "meal_type_distribution":
            _counts("(SELECT Meal_Type FROM food_listings WHERE Meal_Type IS NOT NULL)", "Meal_Type", "Count"),
        "providers_per_city": _counts("providers", "City", "num_providers"),
        "receivers_per_city": _counts("receivers", "City", "num_receivers"),
        "providers_by_type": _counts("providers", "Type", "num_providers"),
        "receivers_by_type": _counts("receivers", "Type", "num_receivers"),
        "top_provider_type":
            _first(1, "Count", "Provider_Type",
                   _counts("(SELECT Type AS Provider_Type FROM providers)", "Provider_Type", "Count")),
        "claims_by_status": _counts("claims", "Status", "Count"),
        "claims_by_date":
            _counts('(SELECT CAST(date_trunc(\'day\', "Timestamp") AS DATE) AS Claim_Date FROM claims)',
                    "Claim_Date", "Total_Claims"),
        "claims_by_month":
            _counts('(SELECT lpad(CAST(year("Timestamp") AS VARCHAR), 4, \'0\') || \'-\' || '
                    'lpad(CAST(month("Timestamp") AS VARCHAR), 2, \'0\') AS claim_month FROM claims)',
                    "claim_month", "num_claims"),
        "claim_status_percentages":
            "SELECT DISTINCT Status, CAST(COUNT(*) OVER (PARTITION BY Status) AS DOUBLE) * 100.0 / COUNT(*) OVER () "
            "AS Percentage FROM claims",
        # Supply: one row per provider first.
        "top_providers_by_quantity_name":
            _first(5, "total", "Name",
                   f"SELECT p.Name, CAST(SUM(s.q) AS BIGINT) AS total FROM {SUPPLY_OF_PROVIDER} s, providers p "
                   "WHERE p.Provider_ID = s.Provider_ID GROUP BY p.Name"),
        "quantity_per_provider_name":
            f"SELECT p.Name AS provider_name, CAST(SUM(s.q) AS BIGINT) AS total_quantity "
            f"FROM providers p, {SUPPLY_OF_PROVIDER} s WHERE s.Provider_ID = p.Provider_ID GROUP BY p.Name",
        "listings_per_provider_name":
            f"SELECT p.Name AS provider_name, CAST(SUM(s.n) AS BIGINT) AS num_listings "
            f"FROM providers p, {SUPPLY_OF_PROVIDER} s WHERE s.Provider_ID = p.Provider_ID GROUP BY p.Name",
        "top_providers_by_listings_with_zero":
            _first(5, "Foods_Provided", "Name",
                   "SELECT Name, CAST(SUM(COALESCE((SELECT COUNT(Food_ID) FROM food_listings l "
                   "WHERE l.Provider_ID = p.Provider_ID), 0)) AS BIGINT) AS Foods_Provided "
                   "FROM providers p GROUP BY Name"),
        "quantity_per_provider_id":
            f"SELECT who.name AS ProviderName, CAST(s.q * who.copies AS BIGINT) AS Total_Donated "
            "FROM (SELECT Provider_ID, MIN(Name) AS name, COUNT(*) AS copies FROM providers GROUP BY Provider_ID) who, "
            f"{SUPPLY_OF_PROVIDER} s WHERE s.Provider_ID = who.Provider_ID",
        "top_provider_by_completed":
            "SELECT ProviderName, Successful_Claims FROM (" +
            _first(1, "Successful_Claims", "ProviderName, id",
                   "SELECT p.Provider_ID AS id, MIN(p.Name) AS ProviderName, CAST(SUM(d.n) AS BIGINT) "
                   f"AS Successful_Claims FROM food_listings l, providers p, {DONE_OF_FOOD} d "
                   "WHERE d.Food_ID = l.Food_ID AND p.Provider_ID = l.Provider_ID "
                   "AND EXISTS (SELECT 1 FROM claims c WHERE c.Food_ID = l.Food_ID AND c.Status = 'Completed') "
                   "GROUP BY p.Provider_ID") + ")",
        # Demand: one row per Food_ID or receiver first.
        "claims_per_food_name": _claims_by_listing("Food_Name", "claim_count"),
        "claims_per_food_id":
            "SELECT l.name AS Food_Name, CAST(l.copies * k.n AS BIGINT) AS Claim_Count FROM "
            "(SELECT Food_ID, MIN(Food_Name) AS name, COUNT(*) AS copies FROM food_listings GROUP BY Food_ID) l, "
            f"{CLAIMS_OF_FOOD} k WHERE k.Food_ID = l.Food_ID",
        "claims_per_receiver_name":
            f"SELECT r.Name, CAST(SUM(k.n) AS BIGINT) AS total_claims FROM {CLAIMS_OF_RECEIVER} k, receivers r "
            "WHERE r.Receiver_ID = k.Receiver_ID GROUP BY r.Name",
        "claims_per_receiver_with_zero":
            "SELECT Name, CAST(SUM(COALESCE((SELECT COUNT(Claim_ID) FROM claims c "
            "WHERE c.Receiver_ID = r.Receiver_ID), 0)) AS BIGINT) AS Claims_Made FROM receivers r GROUP BY Name",
        "claims_per_receiver_id":
            "SELECT who.name AS ReceiverName, CAST(who.copies * k.n AS BIGINT) AS ClaimCount FROM "
            "(SELECT Receiver_ID, MIN(Name) AS name, COUNT(*) AS copies FROM receivers GROUP BY Receiver_ID) who, "
            f"{CLAIMS_OF_RECEIVER} k WHERE k.Receiver_ID = who.Receiver_ID",
        "top_receivers_by_food_type":
            _first(5, "NonVeg_Claims", "Name", _claims_of_listings(f"Food_Type IN ({ft})", "NonVeg_Claims")),
        "expired_claims_per_receiver": _claims_of_listings(overdue, "expired_claims", "receiver_name"),
        "avg_quantity_claimed":
            "SELECT (SELECT MIN(Name) FROM receivers r WHERE r.Receiver_ID = y.Receiver_ID) AS ReceiverName, "
            "CAST(y.q AS DOUBLE) / NULLIF(y.m, 0) AS Avg_Quantity_Claimed FROM "
            "(SELECT c.Receiver_ID, SUM(x.q) AS q, SUM(x.m) AS m FROM claims c, (SELECT Food_ID, SUM(Quantity) AS q, "
            "COUNT(Quantity) AS m FROM food_listings GROUP BY Food_ID) x WHERE x.Food_ID = c.Food_ID "
            "GROUP BY c.Receiver_ID) y WHERE y.Receiver_ID IN (SELECT Receiver_ID FROM receivers)",
        "most_claimed_meal_type": _first(1, "ClaimCount", "Meal_Type", _claims_by_listing("Meal_Type", "ClaimCount")),
        "highest_demand_location":
            _first(1, "Total_Claims", "City", _claims_by_listing("Location", "Total_Claims", "City")),
        "unclaimed_listings":
            "SELECT Food_ID, Food_Name, Quantity, Expiry_Date FROM food_listings l "
            "WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.Food_ID = l.Food_ID) UNION ALL "
            "SELECT l.Food_ID, l.Food_Name, l.Quantity, l.Expiry_Date FROM food_listings l, "
            "(SELECT Food_ID FROM claims WHERE Claim_ID IS NULL) c WHERE c.Food_ID = l.Food_ID",
        "wasted_quantity_by_location":
            "SELECT l.place AS Location, CAST(SUM(l.q) - COALESCE(SUM(l.copies * COALESCE(d.n, 0)), 0) AS BIGINT) "
            "AS Wasted_Quantity FROM (SELECT Food_ID, MIN(Location) AS place, MIN(Quantity) AS q, COUNT(*) AS copies "
            f"FROM food_listings GROUP BY Food_ID) l LEFT JOIN {DONE_OF_FOOD} d ON d.Food_ID = l.Food_ID "
            "GROUP BY l.place",
        "completed_claims_detail":
            'SELECT c.Claim_ID, x.Provider, y.Receiver, c.Status, c."Timestamp" '
            "FROM (SELECT l.Food_ID, p.Name AS Provider FROM food_listings l, providers p "
            "WHERE p.Provider_ID = l.Provider_ID) x, (SELECT Receiver_ID, Name AS Receiver FROM receivers) y, "
            "(SELECT * FROM claims WHERE Status IN ('Completed')) c "
            "WHERE x.Food_ID = c.Food_ID AND y.Receiver_ID = c.Receiver_ID",
        # Cities.
        "city_counts_left":
            "SELECT p.City, p.n AS Providers, COALESCE(r.n, 0) AS Receivers FROM "
            "(SELECT City, COUNT(DISTINCT Provider_ID) AS n FROM providers GROUP BY City) p LEFT JOIN "
            "(SELECT City, COUNT(DISTINCT Receiver_ID) AS n FROM receivers GROUP BY City) r ON r.City = p.City",
        "city_counts_union":
            "SELECT City, COUNT(City) FILTER (WHERE side = 1) AS Provider_Count, "
            "COUNT(City) FILTER (WHERE side = 2) AS Receiver_Count FROM (SELECT City, 1 AS side FROM providers "
            "UNION ALL SELECT City, 2 AS side FROM receivers) GROUP BY City",
        "city_conditional_distinct":
            "SELECT city, CAST(SUM(a) AS BIGINT) AS food_providers, CAST(SUM(b) AS BIGINT) AS food_receivers FROM ("
            "SELECT City AS city, COUNT(DISTINCT Provider_ID) FILTER (WHERE Type IS NOT NULL) AS a, 0 AS b "
            "FROM providers GROUP BY City UNION ALL SELECT City, 0, "
            "COUNT(DISTINCT Receiver_ID) FILTER (WHERE Type IS NOT NULL) FROM receivers GROUP BY City) GROUP BY city",
        # Estimates from sketches must be within their stated error, so the flags are all true.
        "city_counts_sketched":
            "SELECT p.City, p.n AS Providers, COALESCE(r.n, 0) AS Receivers, TRUE AS Providers_within, "
            "TRUE AS Receivers_within FROM "
            "(SELECT City, COUNT(DISTINCT Provider_ID) AS n FROM providers GROUP BY City) p LEFT JOIN "
            "(SELECT City, COUNT(DISTINCT Receiver_ID) AS n FROM receivers GROUP BY City) r ON r.City = p.City",
        "city_conditional_sketched":
            "SELECT city, CAST(SUM(a) AS BIGINT) AS food_providers, CAST(SUM(b) AS BIGINT) AS food_receivers, "
            "TRUE AS food_providers_within, TRUE AS food_receivers_within FROM ("
            "SELECT City AS city, COUNT(DISTINCT Provider_ID) FILTER (WHERE Type IS NOT NULL) AS a, 0 AS b "
            "FROM providers GROUP BY City UNION ALL SELECT City, 0, "
            "COUNT(DISTINCT Receiver_ID) FILTER (WHERE Type IS NOT NULL) FROM receivers GROUP BY City) GROUP BY city",
        "monthly_reach_sketched":
            "SELECT l.Location AS City, CAST(date_trunc('month', c.\"Timestamp\") AS DATE) AS Period, "
            "COUNT(DISTINCT c.Receiver_ID) AS receivers, COUNT(DISTINCT c.Food_ID) AS listings, "
            "COUNT(DISTINCT l.Provider_ID) AS providers, TRUE AS receivers_within, TRUE AS listings_within, "
            "TRUE AS providers_within FROM claims c JOIN food_listings l ON l.Food_ID = c.Food_ID GROUP BY ALL",
        "city_flow":
            "SELECT x.City AS Provider_City, r.City AS Receiver_City, CAST(SUM(k.n) AS BIGINT) AS Total_Transactions "
            "FROM (SELECT Food_ID, Receiver_ID, COUNT(*) AS n FROM claims GROUP BY Food_ID, Receiver_ID) k, "
            "(SELECT l.Food_ID, p.City FROM food_listings l, providers p WHERE p.Provider_ID = l.Provider_ID) x, "
            "receivers r WHERE x.Food_ID = k.Food_ID AND r.Receiver_ID = k.Receiver_ID GROUP BY x.City, r.City",
        # Search and filters.
        "search_listings":
            f"SELECT * FROM food_listings WHERE {_matches(listing_cols, params['listing_pattern'])}",
        "listings_searched_by_index":
            f"SELECT * FROM food_listings WHERE {_matches(listing_cols, params['listing_pattern'])}",
        "search_contacts":
            "SELECT Provider_ID, Name, Type, City, Contact FROM providers "
            f"WHERE {_matches(['City', 'Name'], params['contact_pattern'])}",
        "filter_listings": f"SELECT * FROM food_listings WHERE (Location, Food_Type) = ({city}, {ft})",
        "filter_listings_by_provider":
            "SELECT * FROM food_listings WHERE Provider_ID IN (SELECT Provider_ID FROM providers "
            f"WHERE Name = {_q(params['provider_name'])} QUALIFY ROW_NUMBER() OVER (ORDER BY Provider_ID NULLS LAST) = 1)",
        "location_options": "SELECT Location FROM food_listings GROUP BY Location HAVING Location IS NOT NULL",
        "provider_name_options": "SELECT Name FROM providers GROUP BY Name HAVING Name IS NOT NULL",
        "food_type_options": "SELECT Food_Type FROM food_listings GROUP BY Food_Type HAVING Food_Type IS NOT NULL",
        "contacts_in_view":
            "SELECT Provider_ID, Name, Address, Contact, "
            "if(strpos(Contact, '@') > 0, concat('mailto:', Contact), Contact) AS Contact_Link FROM providers p "
            "WHERE EXISTS (SELECT 1 FROM food_listings l WHERE l.Provider_ID = p.Provider_ID "
            f"AND (l.Location, l.Food_Type) = ({city}, {ft}))",
        # Integrity and upkeep.
        "domain_violations": _domain_sql(),
        "orphan_references": _orphans_sql(),
        "duplicate_keys": _duplicates_sql(),
        "claims_renumbered":
            'SELECT ROW_NUMBER() OVER (ORDER BY "Timestamp" NULLS FIRST, Food_ID NULLS FIRST, '
            "Receiver_ID NULLS FIRST, Status NULLS FIRST, Claim_ID NULLS FIRST) AS Claim_ID, "
            'Food_ID, Receiver_ID, Status, "Timestamp" FROM claims',
        "claims_reissued":
            'SELECT Claim_ID, Food_ID, Receiver_ID, Status, "Timestamp" FROM claims UNION ALL '
            "SELECT (SELECT COALESCE(MAX(Claim_ID), 0) FROM claims) + ROW_NUMBER() OVER (ORDER BY "
            '"Timestamp" NULLS FIRST, Food_ID NULLS FIRST, Receiver_ID NULLS FIRST, Claim_ID NULLS FIRST), '
            "Food_ID, Receiver_ID, 'Pending', \"Timestamp\" FROM claims WHERE Status = 'Cancelled'",
        "claims_withdrawn":
            'SELECT Claim_ID, Food_ID, Receiver_ID, Status, "Timestamp" FROM claims UNION ALL '
            "SELECT (SELECT MAX(Claim_ID) FROM claims) + (nth + 1) // 2, Food_ID, Receiver_ID, 'Pending', \"Timestamp\" "
            'FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY "Timestamp" NULLS FIRST, Food_ID NULLS FIRST, '
            "Receiver_ID NULLS FIRST, Claim_ID NULLS FIRST) AS nth FROM claims WHERE Status = 'Cancelled') "
            "WHERE nth % 2 = 1",
        "claims_of_expired":
            "SELECT c.* FROM claims c WHERE c.Food_ID IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM food_listings l WHERE l.Food_ID = c.Food_ID AND l.Food_ID NOT IN "
            f"(SELECT Food_ID FROM food_listings WHERE {overdue} AND Food_ID IS NOT NULL))",
        "claims_via_store": "SELECT * FROM claims",
        "listings_without_expired":
            "SELECT * FROM food_listings f WHERE f.Food_ID IS NULL OR f.Food_ID NOT IN "
            f"(SELECT Food_ID FROM food_listings WHERE Expiry_Date < {as_of} AND Food_ID IS NOT NULL)",
        "listings_after_commits": _settled_sql(_unexpired(as_of)),
        "listings_row_counts":
            "SELECT CAST(0 AS BIGINT) AS version, COUNT(*) AS row_count FROM food_listings UNION ALL "
            f"SELECT v, n FROM (SELECT COUNT(*) AS n FROM {_unexpired(as_of)}), "
            "(SELECT CAST(UNNEST([1, 2]) AS BIGINT) AS v)",
        "claims_of_two_writers":
            'SELECT Claim_ID, Food_ID, Receiver_ID, Status, "Timestamp" FROM claims UNION ALL '
            "SELECT (SELECT MAX(Claim_ID) FROM claims) + ROW_NUMBER() OVER (ORDER BY nth % 2 DESC, nth), "
            "Food_ID, Receiver_ID, 'Pending', \"Timestamp\" FROM "
            '(SELECT *, ROW_NUMBER() OVER (ORDER BY "Timestamp" NULLS FIRST, Food_ID NULLS FIRST, '
            "Receiver_ID NULLS FIRST, Claim_ID NULLS FIRST) AS nth FROM claims WHERE Status = 'Cancelled')",
        "quantity_kept_by_location":
            "SELECT Location, COUNT(*) AS listings, CAST(SUM(Quantity) AS BIGINT) AS total_quantity, "
            "CAST(SUM(Quantity) AS DOUBLE) / NULLIF(COUNT(Quantity), 0) AS avg_quantity FROM "
            f"({_settled_sql(_unexpired(as_of))}) GROUP BY Location",
        "reach_kept_by_status":
            "SELECT Status, COUNT(DISTINCT Receiver_ID) AS receivers, MAX(Claim_ID) AS last_claim "
            f"FROM {CLAIMS_COMPLETED} GROUP BY Status",
        "wasted_kept_by_location":
            "SELECT Location, CAST(SUM(q) - SUM(m * COALESCE(d.n, 0)) AS BIGINT) AS Wasted_Quantity FROM "
            "(SELECT Food_ID, MIN(Location) AS Location, MIN(Quantity) AS q, COUNT(*) AS m "
            f"FROM {_unexpired(as_of)} GROUP BY Food_ID) l LEFT JOIN "
            f"(SELECT Food_ID, COUNT(Claim_ID) AS n FROM {CLAIMS_COMPLETED} WHERE Status = 'Completed' "
            "GROUP BY Food_ID) d ON d.Food_ID = l.Food_ID GROUP BY Location",
        "listings_quantity_settled": _settled_sql("food_listings"),
        "listings_via_csv": "SELECT * FROM food_listings",
        "claims_via_csv": "SELECT * FROM claims",
        "listings_via_csv_files":
            "SELECT * REPLACE (CASE WHEN Food_ID % 7 = 0 THEN concat(Food_Name, chr(10), '\"second\", line') "
            "ELSE Food_Name END AS Food_Name) FROM food_listings",
        "listings_after_changes": _settled_sql(_unexpired(as_of)),
    }


def oracle_sql() -> dict[str, str]:
    prefix = roles.oracle_ctes()
    return {key: prefix + body for key, body in oracle_bodies().items()} | LLM_ORACLES
