"""Stored tables: full-replace load and typed read-back (parquet).

Two layouts:

* default: listings range-partitioned and sorted by Expiry_Date, claims by
  Timestamp, so the parquet min/max statistics let date predicates skip whole
  files and row groups. Joins shuffle on their keys.
* ``buckets=n``: listings and claims bucketed (and sorted) by Food_ID into
  ``n`` buckets. Claims aggregated per Food_ID and joined to listings then need
  no exchange at all (both sides are already hash-distributed the same way),
  which removes the claims-sized shuffle from every Food_ID metric. Pick ``n``
  so one claims bucket is about 256 MB-1 GB. Bucketing co-locates equal keys:
  a Food_ID holding a large share of the claims makes one bucket (and the one
  task that reads it) as large. Use it where no key dominates; the default
  layout leaves hot keys to partial aggregation and AQE's skew handling.

The layout is recorded next to the tables (``_layout``) so ``load_tables``
re-registers the bucket spec in the session catalog over the same files.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.schema import SCHEMAS
from gleaner.tables import Tables

CLUSTER_BY = {"food_listings": "Expiry_Date", "claims": "Timestamp"}
BUCKET_BY = {"food_listings": "Food_ID", "claims": "Food_ID"}


def _table_name(path: str, table: str) -> str:
    return f"gleaner_{table}_{hashlib.sha1(path.encode()).hexdigest()[:10]}"


def save_table(df: DataFrame, path: str, table: str, files: int | None = None) -> None:
    """Replace the table at ``path`` clustered by its date column (default layout)."""
    col = CLUSTER_BY.get(table)
    out = df
    if col is not None:
        # A tie-breaker after the date lets the range partitioner split a date
        # that holds a large share of the rows over several files.
        tied = df.withColumn("_tie", F.monotonically_increasing_id())
        out = (tied.repartitionByRange(files, col, "_tie") if files
               else tied.repartitionByRange(col, "_tie"))
        out = out.sortWithinPartitions(col).drop("_tie")
    elif files:
        out = df.repartition(files)
    out.write.mode("overwrite").parquet(path)


def save_bucketed(df: DataFrame, path: str, table: str, buckets: int) -> None:
    """Replace the table at ``path`` bucketed and sorted by its Food_ID (one file per bucket)."""
    key = BUCKET_BY[table]
    name = _table_name(path, table)
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    (df.repartition(buckets, F.col(key)).write.mode("overwrite")
     .bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name))


def save_tables(tables: Tables, root: str, files: int | None = None,
                buckets: int | None = None) -> None:
    spark = tables.providers.sparkSession
    layout = []
    for name, df in tables.by_name().items():
        if buckets and name in BUCKET_BY:
            save_bucketed(df, f"{root}/{name}", name, buckets)
            layout.append((name, BUCKET_BY[name], buckets))
        else:
            save_table(df, f"{root}/{name}", name, files)
    (spark.createDataFrame(layout, "table_name string, bucket_column string, buckets int")
     .coalesce(1).write.mode("overwrite").parquet(f"{root}/_layout"))


def load_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(path)


def load_bucketed(spark: SparkSession, path: str, table: str, column: str, buckets: int) -> DataFrame:
    """Register the bucketed files at ``path`` in the session catalog and read them."""
    name = _table_name(path, table)
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SCHEMAS[table].fields)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({cols}) USING parquet CLUSTERED BY (`{column}`) "
              f"SORTED BY (`{column}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def load_tables(spark: SparkSession, root: str) -> Tables:
    try:
        layout = {r["table_name"]: (r["bucket_column"], r["buckets"])
                  for r in spark.read.parquet(f"{root}/_layout").collect()}  # <= 4 rows
    except AnalysisException:
        layout = {}
    t = {}
    for name in SCHEMAS:
        if name in layout:
            t[name] = load_bucketed(spark, f"{root}/{name}", name, *layout[name])
        else:
            t[name] = load_table(spark, f"{root}/{name}", name)
    return Tables(t["providers"], t["receivers"], t["food_listings"], t["claims"])
