"""Command line: load CSV files, run the catalogue, report integrity.

    python -m gleaner load  --csv DIR --store DIR
    python -m gleaner run   (--csv DIR | --store DIR) --out DIR [--as-of D] [--city C] ...
    python -m gleaner check (--csv DIR | --store DIR) --out DIR
    python -m gleaner explain (--csv DIR | --store DIR) --query KEY

    python -m gleaner apply --store DIR --table T --changes DIR --out DIR

Under ``spark-submit`` the submitted session is used; ``--local`` starts
``local[*]`` instead. Every command sizes its partitions for its input: the
bytes under the input folder (or ``--input-bytes``) and the session's cores (or
``--cores``); settings that are already set stay.
"""

from __future__ import annotations

import argparse
import os
import sys

if not __package__:  # run as a file path: make the package importable
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from gleaner.operators import quality  # noqa: E402
from gleaner.operators.changes import apply_changes  # noqa: E402
from gleaner.plans.catalog import CATALOGUE  # noqa: E402
from gleaner.plans.runner import run_catalogue  # noqa: E402
from gleaner.session import DEFAULTS, folder_bytes, local_session, sized_settings  # noqa: E402
from gleaner.schema import KEYS, SCHEMAS, change_schema  # noqa: E402
from gleaner.sinks.writer import write_result  # noqa: E402
from gleaner.sources.csv import ingest_report, read_csv_tables  # noqa: E402
from gleaner.sources.store import load_table, load_tables, save_table, save_tables  # noqa: E402
from gleaner.sources.versions import VersionedTable, load_versioned, save_versioned  # noqa: E402
from gleaner.tables import Tables  # noqa: E402


def session(local: bool) -> SparkSession:
    if local:
        return local_session(shuffle_partitions=None)
    spark = SparkSession.builder.getOrCreate()
    set_unset(spark, DEFAULTS)
    return spark


def set_unset(spark: SparkSession, settings: dict[str, str]) -> None:
    """Apply runtime SQL settings that nobody has set."""
    for k, v in settings.items():
        if k.startswith("spark.sql.") and spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


def size_for(spark: SparkSession, args) -> None:
    """Partition sizes for the command's input."""
    source = next(p for p in (getattr(args, a, None) for a in ("csv", "store", "versions")) if p)
    size = args.input_bytes or folder_bytes(spark, source)
    set_unset(spark, sized_settings(size, args.cores or spark.sparkContext.defaultParallelism))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gleaner")
    p.add_argument("--local", action="store_true", help="run on local[*]")
    p.add_argument("--input-bytes", type=int, default=None, help="size of the input (default: measured)")
    p.add_argument("--cores", type=int, default=None, help="task slots (default: the session's parallelism)")
    sub = p.add_subparsers(dest="cmd", required=True)

    load = sub.add_parser("load", help="CSV folder -> stored parquet tables")
    load.add_argument("--csv", required=True)
    load.add_argument("--store", required=True)
    load.add_argument("--versioned", type=int, default=None, metavar="BUCKETS",
                      help="as versioned tables of so many buckets (a next version where they exist)")

    for name in ("run", "check", "explain"):
        s = sub.add_parser(name)
        src = s.add_mutually_exclusive_group(required=True)
        src.add_argument("--csv")
        src.add_argument("--store")
        src.add_argument("--versions", help="folder of versioned tables; their newest versions")
        if name != "explain":
            s.add_argument("--out", required=True)

    change = sub.add_parser("apply", help="a change table -> a new snapshot of one stored table, and its checks")
    change.add_argument("--store", required=True)
    change.add_argument("--table", required=True, choices=list(SCHEMAS))
    change.add_argument("--changes", required=True, help="Parquet folder of changes (op, seq, columns, set_columns)")
    change.add_argument("--out", required=True, help="folder of the new snapshot; the store stays as it is")

    commit = sub.add_parser("commit", help="a change table -> the next version of one versioned table")
    commit.add_argument("--versions", required=True)
    commit.add_argument("--table", required=True, choices=list(SCHEMAS))
    commit.add_argument("--changes", required=True, help="Parquet folder of changes (op, seq, columns, set_columns)")
    commit.add_argument("--keep", type=int, default=None, help="versions to retain (default: all)")

    explain = sub.choices["explain"]
    explain.add_argument("--query", required=True, help="catalogue key")

    run = sub.choices["run"]
    for s in (run, explain):
        s.add_argument("--as-of", default=None, help="reference date (default: today)")
        s.add_argument("--city", default="Mumbai")
        s.add_argument("--food-type", default="Non-Veg")
        s.add_argument("--listing-pattern", default="")
        s.add_argument("--contact-pattern", default="")
        s.add_argument("--provider-name", default=None)
    run.add_argument("--queries", default="", help="comma-separated keys (default: all)")
    run.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    run.add_argument("--parallel", type=int, default=4)
    return p


def write_checks(tables: Tables, out: str) -> None:
    write_result(quality.domain_violations(tables), f"{out}/domain_violations")
    write_result(quality.orphan_references(tables), f"{out}/orphan_references")
    write_result(quality.duplicate_keys_all(tables), f"{out}/duplicate_keys")


def main(argv=None) -> int:
    args = parser().parse_args(argv)
    spark = session(args.local)
    size_for(spark, args)

    if args.cmd == "load":
        tables = read_csv_tables(spark, args.csv)
        if args.versioned:
            save_versioned(tables, args.store, args.versioned)
        else:
            save_tables(tables, args.store)
        write_result(ingest_report(spark, args.csv), f"{args.store}/_ingest_report")
        return 0

    if args.cmd == "commit":
        table = VersionedTable.open(spark, f"{args.versions}/{args.table}")
        table.apply(spark.read.schema(change_schema(args.table)).parquet(args.changes))
        if args.keep:
            table.expire(args.keep)
        return 0

    if args.cmd == "apply":
        tables = load_tables(spark, args.store)
        changes = spark.read.schema(change_schema(args.table)).parquet(args.changes)
        changed = apply_changes(tables.by_name()[args.table], changes, KEYS[args.table])
        save_table(changed, f"{args.out}/{args.table}", args.table)
        new = load_table(spark, f"{args.out}/{args.table}", args.table)
        write_checks(Tables(*(new if n == args.table else df for n, df in tables.by_name().items())), f"{args.out}/_checks")
        return 0

    tables = (read_csv_tables(spark, args.csv) if args.csv else load_versioned(spark, args.versions) if args.versions
              else load_tables(spark, args.store))
    if args.cmd == "check":
        write_checks(tables, args.out)
        return 0

    params = {"as_of": args.as_of, "city": args.city, "food_type": args.food_type,
              "listing_pattern": args.listing_pattern, "contact_pattern": args.contact_pattern,
              "provider_name": args.provider_name}
    if args.cmd == "explain":
        CATALOGUE[args.query](tables, **params).explain("formatted")
        return 0
    keys = [k for k in args.queries.split(",") if k] or list(CATALOGUE)
    log = run_catalogue(spark, tables, args.out, params, keys, fmt=args.format,
                        parallel=args.parallel, ordered=False)
    log.orderBy("query").show(len(keys), truncate=80)
    return 1 if log.where("status = 'error'").count() else 0


if __name__ == "__main__":
    sys.exit(main())
