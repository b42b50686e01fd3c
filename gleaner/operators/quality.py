"""Integrity checks: value domains, dangling references, duplicate keys.

The reference declares no keys or constraints; these jobs report what its
forms would have prevented, without changing any row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import schema
from gleaner.tables import Tables

# (table, rule name, column, kind, argument): a non-NULL value is valid when it
# is "in" the listed values, or is at least the "min" value.
DOMAIN_RULES = [
    ("providers", "Type in provider types", "Type", "in", schema.PROVIDER_TYPES),
    ("receivers", "Type in receiver types", "Type", "in", schema.RECEIVER_TYPES),
    ("food_listings", "Food_Type in food types", "Food_Type", "in", schema.FOOD_TYPES),
    ("food_listings", "Meal_Type in meal types", "Meal_Type", "in", schema.MEAL_TYPES),
    ("food_listings", "Quantity >= minimum", "Quantity", "min", schema.MIN_QUANTITY),
    ("claims", "Status in claim statuses", "Status", "in", schema.CLAIM_STATUSES),
]


def _valid(c: Column, kind: str, arg) -> Column:
    return c.isin(*arg) if kind == "in" else c >= F.lit(arg)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def domain_violations(t: Tables, rules=None) -> DataFrame:
    """One row per (table, rule, row_key) whose non-NULL value is outside the rule."""
    by_table: dict[str, list] = {}
    for table, *rule in rules or DOMAIN_RULES:
        by_table.setdefault(table, []).append(rule)
    out = []
    for table, checks in by_table.items():  # one scan per table: each row carries the rules it fails
        failed = [F.when(~_valid(F.col(c), kind, arg), F.struct(
            F.lit(rule).alias("rule"), F.col(c).cast("string").alias("bad_value")))
            for rule, c, kind, arg in checks]
        rows = t.by_name()[table].select(F.col(schema.KEYS[table]).alias("row_key"),
                                         F.explode(F.array_compact(F.array(*failed))).alias("v"))
        out.append(rows.select(F.lit(table).alias("table_name"), "v.rule", "row_key", "v.bad_value"))
    return _union(out)


def orphans(child: DataFrame, parent: DataFrame, fk: str, parent_key: str | None = None) -> DataFrame:
    """Child rows whose non-NULL ``fk`` has no parent row (anti join)."""
    # The parent's keys as they are: with an aggregate under the join (distinct) AQE no longer splits a
    # hot key of the child, and a parent key repeated many times is what duplicate_keys reports.
    keys = parent.select(F.col(parent_key or fk).alias(fk))
    return child.where(F.col(fk).isNotNull()).join(keys, fk, "left_anti")


def orphan_references(t: Tables) -> DataFrame:
    """All dangling references: (table_name, fk_column, row_key, ref_value)."""
    tables = t.by_name()
    out = []
    for table, column, parent in schema.REFERENCES:
        o = orphans(tables[table], tables[parent], column, schema.KEYS[parent])
        out.append(o.select(F.lit(table).alias("table_name"), F.lit(column).alias("fk_column"),
                            F.col(schema.KEYS[table]).alias("row_key"),
                            F.col(column).alias("ref_value")))
    return _union(out)


def duplicate_keys(df: DataFrame, key: str | list[str]) -> DataFrame:
    """Keys carried by more than one row, with the number of copies."""
    keys = [key] if isinstance(key, str) else key
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
            .where(F.col("copies") > 1))


def duplicate_keys_all(t: Tables) -> DataFrame:
    """Duplicate keys of all four tables: (table_name, row_key, copies).

    The four key columns are unioned and grouped once by (table, key): one
    exchange instead of one per table.
    """
    keys = _union([df.select(F.lit(table).alias("table_name"),
                             F.col(schema.KEYS[table]).alias("row_key"))
                   for table, df in t.by_name().items()])
    return duplicate_keys(keys.withColumnRenamed("row_key", "_k"), ["table_name", "_k"]) \
        .select("table_name", F.col("_k").alias("row_key"), "copies")
