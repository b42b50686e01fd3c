"""The four tables as views over the driver's TPC-H-style parquet tables.

The mapping is written once as SQL with ``{table}`` placeholders. Spark fills
them with DataFrames (``spark.sql(text, customer=df, ...)``); the DuckDB oracle
fills them with the bare view names, so both sides run the very same text.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from gleaner.tables import Tables

BASE_TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem")

PROVIDERS_SQL = """
SELECT c.c_custkey AS Provider_ID, c.c_name AS Name, c.c_mktsegment AS Type,
       concat('No. ', CAST(c.c_custkey AS STRING)) AS Address, n.n_name AS City,
       CASE c.c_custkey % 3 WHEN 0 THEN concat(c.c_name, '@example.org') WHEN 1 THEN c.c_name END AS Contact
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
"""

RECEIVERS_SQL = """
SELECT s.s_suppkey AS Receiver_ID, s.s_name AS Name, r.r_name AS Type, n.n_name AS City,
       CAST(NULL AS STRING) AS Contact
FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey
"""

LISTINGS_SQL = """
SELECT o.o_orderkey AS Food_ID, concat(o.o_orderpriority, '/', o.o_orderstatus) AS Food_Name,
       CAST(floor(o.o_totalprice) AS BIGINT) AS Quantity, CAST(o.o_orderdate AS DATE) AS Expiry_Date,
       o.o_custkey AS Provider_ID, c.c_mktsegment AS Provider_Type, n.n_name AS Location,
       o.o_orderstatus AS Food_Type, o.o_orderpriority AS Meal_Type
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
"""

CLAIMS_SQL = """
SELECT l.l_orderkey * 100 + l.l_linenumber AS Claim_ID, l.l_orderkey AS Food_ID,
       l.l_suppkey AS Receiver_ID,
       CASE l.l_returnflag WHEN 'R' THEN 'Completed' WHEN 'N' THEN 'Pending'
                           WHEN 'A' THEN 'Cancelled' END AS Status,
       l.l_shipdate AS {ts}
FROM {lineitem} l
"""

ROLE_SQL = {
    "providers": PROVIDERS_SQL,
    "receivers": RECEIVERS_SQL,
    "food_listings": LISTINGS_SQL,
    "claims": CLAIMS_SQL,
}

# Parameters the role mapping was checked with (FIXTURES.md).
AS_OF = "1998-07-01"
CITY = "NATION_1"
FOOD_TYPE = "F"


def role_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Lazy role views over ``{sf_dir}/<table>.parquet``; no row is read yet.

    Building them lists the files and reads the parquet footers of six tables
    and analyses four SQL texts, so the views are made once per session and
    folder and shared by every query (a DataFrame is immutable). They are kept
    on the session object: each session has its own, with its own settings.
    """
    known = spark.__dict__.setdefault("_gleaner_roles", {})
    if sf_dir not in known:
        known[sf_dir] = _build(spark, sf_dir)
    return known[sf_dir]


def _build(spark: SparkSession, sf_dir: str) -> Tables:
    base = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE_TABLES}

    def view(name: str):
        text = ROLE_SQL[name]
        used = {t: df for t, df in base.items() if "{" + t + "}" in text}
        return spark.sql(text.replace("{ts}", "`Timestamp`"), **used)

    return Tables(view("providers"), view("receivers"), view("food_listings"), view("claims"))


def oracle_ctes() -> str:
    """The same mapping as DuckDB CTEs over the pre-registered base views."""
    names = {t: t for t in BASE_TABLES}
    parts = [f"{name} AS ({text.format(ts='\"Timestamp\"', **names).strip()})"
             for name, text in ROLE_SQL.items()]
    return "WITH " + ",\n".join(parts) + "\n"
