"""CSV ingest checked on whole tables: each row as a CSV line, parsed back typed.

The line is built in a column (RFC 4180: text quoted, quotes doubled, NULL an
empty cell) and parsed with ``from_csv`` and the ingest's ``conform``. Nothing is
written; the frames are lazy and independent of each other. Two queries go through
files: ``listings_via_csv_files`` and ``listings_searched_by_index``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators.search import LISTING_SEARCH_COLUMNS
from gleaner.schema import SCHEMAS
from gleaner.session import ensure_checkpoint_dir
from gleaner.sinks.writer import write_result
from gleaner.sources import gramindex
from gleaner.sources.csv import conform, read_csv_table
from gleaner.tables import Tables


def _cell(name: str, dtype: T.DataType) -> Column:
    text = F.col(f"`{name}`").cast("string")
    if isinstance(dtype, T.StringType):
        text = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(text, F.lit(""))


def via_csv(df: DataFrame, table: str) -> DataFrame:
    fields = SCHEMAS[table].fields
    line = F.concat_ws(",", *[_cell(f.name, f.dataType) for f in fields])
    cells = ", ".join(f"`{f.name}` string" for f in fields)
    return conform(df.select(F.from_csv(line, cells, {"escape": '"'}).alias("r")).select("r.*"), SCHEMAS[table])


def listings_via_csv(t: Tables) -> DataFrame:
    return via_csv(t.listings, "food_listings")


def claims_via_csv(t: Tables) -> DataFrame:
    return via_csv(t.claims, "claims")


def listings_searched_by_index(t: Tables, pattern: str) -> DataFrame:
    """F1 over listings stored with trigram signatures: files that cannot hold a match are not read."""
    path = f"{ensure_checkpoint_dir(t.listings.sparkSession)}/gleaner-grams-{uuid.uuid4().hex}"
    columns = list(LISTING_SEARCH_COLUMNS)
    gramindex.store(t.listings, path, columns)
    return gramindex.search(t.listings.sparkSession, path, t.listings.schema, columns, pattern)


#: What the listings of every seventh id carry behind their name, in files of their own.
BREAK = '\n"second", line'


def listings_via_csv_files(t: Tables) -> DataFrame:
    """Listings written as CSV files and read by the ingest: files with line breaks in quoted fields whole, others in splits.

    Every seventh listing's name gets a line break, a comma and quotes; those rows go to files of their own.
    """
    folder = f"{ensure_checkpoint_dir(t.listings.sparkSession)}/gleaner-csv-{uuid.uuid4().hex}"
    odd = F.coalesce(F.col("Food_ID") % 7 == 0, F.lit(False))
    broken = t.listings.where(odd).withColumn("Food_Name", F.concat("Food_Name", F.lit(BREAK)))
    for name, rows in (("plain", t.listings.where(~odd)), ("broken", broken)):
        write_result(rows, f"{folder}/part={name}", "csv")
    return read_csv_table(t.listings.sparkSession, f"{folder}/part=*/*.csv", "food_listings")
