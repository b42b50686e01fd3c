"""Ad-hoc SQL over the four tables, with bind parameters.

Named (``:city``) and positional (``?``) markers are Spark SQL's own
parameter binding; values are never spliced into the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.tables import Tables


def run_sql(spark: SparkSession, tables: Tables, sql: str,
            params: dict | list | None = None) -> DataFrame:
    """Register ``providers``, ``receivers``, ``food_listings``, ``claims`` and run ``sql``."""
    tables.register()
    return spark.sql(sql, args=params) if params is not None else spark.sql(sql)
