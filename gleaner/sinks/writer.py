"""Write query results: one directory per query under one output root."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace the result at ``path``. CSV gets a header row and RFC 4180 quoting
    (a quote inside a quoted value is doubled), the form the CSV reader expects;
    blanks around a value are kept."""
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = (w.option("header", True).option("escape", '"')
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    elif fmt == "json":
        w = w.option("ignoreNullFields", False)  # keep NULL values as explicit nulls
    w.save(path)


def write_results(results: dict[str, DataFrame], root: str, fmt: str = "parquet") -> None:
    """All results as one bundle: ``root/<query name>``; names are kept whole."""
    for name, df in results.items():
        write_result(df, f"{root}/{name}", fmt)
