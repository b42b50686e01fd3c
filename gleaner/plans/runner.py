"""Run the catalogue as a batch: every result written, a run log beside them.

A failing query is recorded and the run goes on; an empty result is logged as
``empty`` (the reference prints "No data found."). Queries are independent
Spark jobs, so several can be submitted at once from driver threads to keep
a large cluster busy while small queries finish.

Each query's log row is written as soon as the query ends
(``_run_log/query=<key>``), so a run cut short by a lost driver can be resumed:
``resume=True`` skips queries already logged ``ok`` or ``empty`` with the same
parameters and format.

``ordered=False`` leaves out final sorts: a folder of files has no order that
a reader could rely on.
"""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor

from contextlib import nullcontext

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.agg import unordered
from gleaner.plans.catalog import CATALOGUE
from gleaner.sinks.writer import write_result
from gleaner.tables import Tables

ROW_SCHEMA = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("seconds", T.DoubleType()),
    T.StructField("error", T.StringType()),
    T.StructField("params", T.StringType()),
])
COLUMNS = ["query", "status", "row_count", "seconds", "error", "params"]


def _log_root(root: str) -> str:
    return f"{root}/_run_log"


def read_run_log(spark: SparkSession, root: str) -> DataFrame | None:
    """The run log so far (one row per query run), or None before the first query."""
    try:
        return spark.read.parquet(_log_root(root)).select(*COLUMNS)
    except AnalysisException:
        return None


def _used(key: str, params: dict, fmt: str) -> str:
    """What the query's result depends on, as the run log holds it."""
    used = {arg: params.get(p) for arg, p in CATALOGUE[key].bindings().items()}
    return json.dumps(used | {"format": fmt}, default=str, sort_keys=True)


def _run_one(spark: SparkSession, key: str, tables: Tables, root: str, fmt: str, params: dict, ordered: bool):
    t0 = time.time()
    used = _used(key, params, fmt)
    try:
        with nullcontext() if ordered else unordered():
            df = CATALOGUE[key](tables, **params)
        seen = Observation()  # rows are counted as they are written
        write_result(df.observe(seen, F.count(F.lit(1)).alias("n")), f"{root}/{key}", fmt)
        n = seen.get["n"]
        row = ("ok" if n else "empty", n, time.time() - t0, None, used)
    except Exception as e:  # noqa: BLE001 - recorded in the run log
        row = ("error", None, time.time() - t0, f"{type(e).__name__}: {e}", used)
    spark.createDataFrame([row], ROW_SCHEMA).coalesce(1).write.mode("overwrite").parquet(
        f"{_log_root(root)}/query={key}")
    return key


def run_catalogue(spark: SparkSession, tables: Tables, root: str, params: dict,
                  keys: list[str] | None = None, fmt: str = "parquet",
                  parallel: int = 1, resume: bool = False, ordered: bool = True) -> DataFrame:
    """Write each query to ``root/<key>``; return the run log (``root/_run_log``)."""
    keys = list(keys or CATALOGUE)
    if resume:
        done = read_run_log(spark, root)
        if done is not None:
            finished = {(r["query"], r["params"]) for r in done.where("status IN ('ok', 'empty')")
                        .select("query", "params").collect()}
            keys = [k for k in keys if (k, _used(k, params, fmt)) not in finished]
    if parallel > 1:
        with ThreadPoolExecutor(parallel) as pool:
            list(pool.map(lambda k: _run_one(spark, k, tables, root, fmt, params, ordered), keys))
    else:
        for k in keys:
            _run_one(spark, k, tables, root, fmt, params, ordered)
    return read_run_log(spark, root)
