"""CSV ingest: header cleanup, blank markers, typed columns, unparsable values become NULL.

The CSV is read as text (no ``inferSchema``, which would scan the data twice),
column names are stripped of surrounding spaces, blank markers become NULL, and
each column of the table's schema is parsed with ``try_`` functions so bad values
turn into NULL instead of failing the job under ANSI mode. ``parse_report``
counts them.

A quoted field may hold line breaks. A file with such fields cannot be split, so
one task reads it whole; all others are read in splits. Which is which is found
by a parallel pass over the text; ``multi_line`` states it instead.

Lines with a wrong number of fields keep what fits, and the whole line is kept
in ``_corrupt_record`` (:func:`bad_records`).
"""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.schema import SCHEMAS
from gleaner.tables import Tables

CORRUPT = "_corrupt_record"

# Cells that count as missing.
BLANK_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Shapes of a date at the start of a cell, each with its rewriting to year-month-day.
# Month stands before day unless it cannot be a month.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
YEAR_FIRST = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)"
DIGITS = r"^(\d{4})(\d{2})(\d{2})(?!\d)"
YEAR_LAST = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?!\d)"
MONTH_NAME = r"^(?:[A-Za-z]{3,9},? +)?([A-Za-z]{3})[a-z]*\.? +(\d{1,2})(?:st|nd|rd|th)?,? +(\d{4})(?!\d)"
DAY_MONTH_NAME = r"^(?:[A-Za-z]{3,9},? +)?(\d{1,2})(?:st|nd|rd|th)?[ -]([A-Za-z]{3})[a-z]*\.?[ ,-]+(\d{4})(?!\d)"
TIME = (r"^(?:[T ] *(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)? *([AaPp][Mm])? *"
        r"(Z|UTC|GMT|[+-]\d{2}:?\d{2})?)?$")


def _moment(text: Column) -> Column:
    """The local date and time in a cell, in UTC if it names a zone; NULL if it holds none.

    Fractions beyond microseconds are cut.
    """
    def part(pattern: str, k: int) -> Column:
        return F.regexp_extract(text, pattern, k)

    def number(c: Column) -> Column:
        return c.try_cast("int")

    def month(c: Column) -> Column:
        at = F.instr(F.lit(MONTHS), F.lower(c))
        return F.when((at > 0) & (at % 3 == 1), ((at + 2) / 3).cast("int"))

    shape = (F.when(text.rlike(YEAR_FIRST), 1).when(text.rlike(DIGITS), 2).when(text.rlike(YEAR_LAST), 3)
             .when(text.rlike(MONTH_NAME), 4).when(text.rlike(DAY_MONTH_NAME), 5))
    first, second = number(part(YEAR_LAST, 1)), number(part(YEAR_LAST, 2))
    day_first = (first > 12) & (second <= 12)

    def chosen(*by_shape: Column) -> Column:
        out = F.when(shape == 1, by_shape[0])
        for k, c in enumerate(by_shape[1:], 2):
            out = out.when(shape == k, c)
        return out

    year = chosen(*(number(part(p, k)) for p, k in
                    ((YEAR_FIRST, 1), (DIGITS, 1), (YEAR_LAST, 3), (MONTH_NAME, 3), (DAY_MONTH_NAME, 3))))
    mon = chosen(number(part(YEAR_FIRST, 2)), number(part(DIGITS, 2)), F.when(day_first, second).otherwise(first),
                 month(part(MONTH_NAME, 1)), month(part(DAY_MONTH_NAME, 2)))
    day = chosen(number(part(YEAR_FIRST, 3)), number(part(DIGITS, 3)), F.when(day_first, first).otherwise(second),
                 number(part(MONTH_NAME, 2)), number(part(DAY_MONTH_NAME, 1)))
    rest = chosen(*(F.regexp_replace(text, p, "") for p in
                    (YEAR_FIRST, DIGITS, YEAR_LAST, MONTH_NAME, DAY_MONTH_NAME)))

    def time(k: int) -> Column:
        return F.regexp_extract(rest, TIME, k)

    half = F.lower(time(5))
    clock = number(time(1))
    hour = F.coalesce(F.when(half == "", clock)
                      .when(clock.between(1, 12), clock % 12 + F.when(half == "pm", 12).otherwise(0))
                      .when(half != "", F.lit(99)), F.lit(0))
    second_text = F.concat(F.when(time(3) == "", "0").otherwise(time(3)), F.lit("."),
                           F.rpad(F.substring(time(4), 1, 6), 6, "0"))
    local = F.when(rest.rlike(TIME), F.try_make_timestamp_ntz(
        year, mon, day, hour, F.coalesce(number(time(2)), F.lit(0)), second_text.try_cast("decimal(16,6)")))
    zone = time(6)
    minutes = F.when(zone.rlike(r"^[+-]"), (
        number(F.substring(zone, 2, 2)) * 60 + number(F.substring(zone, -2, 2)))
        * F.when(zone.startswith("-"), -1).otherwise(1)).otherwise(0)
    return local - F.make_dt_interval(mins=minutes)

# The file each table is read from.
FILE_NAMES = {
    "providers": "providers_data.csv",
    "receivers": "receivers_data.csv",
    "food_listings": "food_listings_data.csv",
    "claims": "claims_data.csv",
}


def _marked(c: Column) -> Column:
    """The cell, NULL where it holds a blank marker."""
    return F.when(~c.isin(*BLANK_MARKERS), c)


def _parse(c: Column, dtype: T.DataType) -> Column:
    c = _marked(c)
    text = F.trim(c)
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, (T.DateType, T.TimestampNTZType, T.TimestampType)):
        return _moment(text).cast(dtype)
    if isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType)):
        # "12.0" (an integer column exported with NaNs) is accepted; "12.5" is not.
        d = text.try_cast("double")
        integral = F.when(d == F.floor(d), F.floor(d)).try_cast(dtype)
        return F.coalesce(text.try_cast(dtype), integral)
    return text.try_cast(dtype)


def conform(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Strip header names, then select the schema's columns, parsed; missing ones are NULL."""
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    cols = []
    for f in schema.fields:
        if f.name in raw.columns:
            cols.append(_parse(F.col(f"`{f.name}`"), f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return raw.select(*cols)


def parse_report(raw: DataFrame, schema: T.StructType, table: str) -> DataFrame:
    """Per typed column: how many non-blank cells could not be parsed."""
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    aggs = []
    for f in schema.fields:
        if f.name not in raw.columns or isinstance(f.dataType, T.StringType):
            continue
        c = F.col(f"`{f.name}`")
        lost = (F.trim(_marked(c)) != F.lit("")) & _parse(c, f.dataType).isNull()
        aggs.append(F.sum(F.when(lost, 1).otherwise(0)).alias(f.name))
    if not aggs:
        return raw.sparkSession.createDataFrame([], "table_name string, column string, unparsed long")
    wide = raw.agg(*aggs)
    names = [a for a in wide.columns]
    stack = ", ".join(f"'{n}', `{n}`" for n in names)
    return wide.selectExpr(f"'{table}' AS table_name",
                           f"stack({len(names)}, {stack}) AS (column, unparsed)")


def files_with_breaks(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The files in which some line has an odd number of quotes, so that a quoted field goes on in the next line, and
    the others.

    One parallel pass over the text in splits, whatever the files' sizes; one row a file comes back. A stray quote
    counts as well, which costs that file its parallel read and nothing else.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    seen = lines.groupBy("file").agg(F.bool_or(odd).alias("odd")).collect()
    return tuple(sorted(unquote(r["file"]) for r in seen if r["odd"] == which) for which in (True, False))


def read_raw(spark: SparkSession, path: str, multi_line: bool | None = None, keep_bad: bool = False) -> DataFrame:
    """All columns as text, header row used for names, RFC 4180 quoting
    (a doubled quote inside quotes is one quote).

    Files without quoted line breaks are read in splits by many tasks, the others
    (:func:`files_with_breaks`) whole, one task each; ``multi_line`` states for all
    of them which it is and saves that pass.

    A line with too few fields gets NULLs for the missing ones, one with too many
    loses the last; ``keep_bad`` adds ``_corrupt_record``, the whole line where that
    happened.
    """
    parts, header_breaks = None, multi_line is True
    if multi_line is None:
        whole, plain = files_with_breaks(spark, path)
        multi_line = bool(whole)
        # Names in which a reader would look for patterns cannot be given one by one: all files are read whole.
        named = not any(set("[]{}*?") & set(f) for f in whole + plain)
        header_breaks = multi_line and named
        parts = (plain, whole) if whole and plain and named else None
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"')
    # One file's header line: names come from the first file, columns go by their place.
    names = reader.option("multiLine", header_breaks).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names + [CORRUPT] * keep_bad])
    # A line's number of fields is only compared with the header's where all columns are parsed.
    reader = reader.option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", not keep_bad).schema(schema)
    if parts:
        return reader.option("multiLine", False).csv(parts[0]).unionByName(reader.option("multiLine", True).csv(parts[1]))
    return reader.option("multiLine", multi_line).csv(path)


def bad_records(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """The lines whose number of fields differs from the header's: their columns as read, and the whole line."""
    return read_raw(spark, path, multi_line, keep_bad=True).where(F.col(CORRUPT).isNotNull())


def malformed_lines(spark: SparkSession, path: str, table: str, multi_line: bool | None = None) -> DataFrame:
    """How many lines :func:`bad_records` holds: (table_name, column, unparsed)."""
    raw = read_raw(spark, path, multi_line, keep_bad=True)
    # Spark reads no CSV for the corrupt column alone: the condition looks at another one too.
    seen = F.length(F.concat_ws("", F.col(f"`{raw.columns[0]}`"), F.col(CORRUPT))) > 0
    bad = F.sum(F.when(F.col(CORRUPT).isNotNull() & seen, 1).otherwise(0))
    return raw.agg(F.coalesce(bad, F.lit(0)).cast("long").alias("unparsed")).select(
        F.lit(table).alias("table_name"), F.lit("_malformed_lines").alias("column"), "unparsed")


def read_csv_table(spark: SparkSession, path: str, table: str, multi_line: bool | None = None) -> DataFrame:
    return conform(read_raw(spark, path, multi_line), SCHEMAS[table])


def _missing(e: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e)


def read_csv_table_if_exists(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Like :func:`read_csv_table`; a missing path gives an empty table with the schema."""
    try:
        raw = read_raw(spark, path)
    except AnalysisException as e:
        if not _missing(e):
            raise
        return spark.createDataFrame([], SCHEMAS[table])
    return conform(raw, SCHEMAS[table])


def read_csv_tables(spark: SparkSession, folder: str, file_names: dict | None = None) -> Tables:
    """The four tables from one folder of CSV files; absent files give empty tables."""
    names = file_names or FILE_NAMES
    t = {name: read_csv_table_if_exists(spark, f"{folder}/{names[name]}", name) for name in SCHEMAS}
    return Tables(t["providers"], t["receivers"], t["food_listings"], t["claims"])


def ingest_report(spark: SparkSession, folder: str, file_names: dict | None = None) -> DataFrame:
    """Unparsable cells per table and column over a folder of CSV files,
    plus one ``_malformed_lines`` row per table (wrong number of fields)."""
    names = file_names or FILE_NAMES
    parts = []
    for name, schema in SCHEMAS.items():
        path = f"{folder}/{names[name]}"
        try:
            raw = read_raw(spark, path)
        except AnalysisException as e:
            if not _missing(e):
                raise
            continue
        parts.append(parse_report(raw, schema, name))
        parts.append(malformed_lines(spark, path, name))
    if not parts:
        return spark.createDataFrame([], "table_name string, column string, unparsed long")
    return reduce(DataFrame.unionByName, parts)
