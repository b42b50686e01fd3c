"""Versioned tables: copy-on-write of the buckets that a batch touches, published by one atomic step.

A table is dealt to buckets by a hash of its key columns. A version is a list of
buckets, each with the commit that wrote it:

    root/data/<commit>/bucket=<b>/    files of the buckets a commit wrote
    root/entries/<commit>/            the version's buckets: (bucket, commit, rows, top)
    root/versions/<number>            the version: one small file, written last

A batch of changes reads and rewrites the buckets its keys fall in; all others
keep their files. Data and entries are in place before the version file appears,
by a rename that never replaces, so a reader sees the old version or the new one,
and a writer that is killed leaves the old one. Two writers that start from one
version cannot both publish the next: the later one finds the number taken and
does its batch again on top of the other's, with ids numbered anew, so ids given
without one never collide. A transaction name and number make a retried batch
(of a stream) a batch that is already there.

The entries hold each bucket's rows and highest id, so a row count and the next id
need no scan; ids between deletes need only the keys of the deletes' buckets.

Buckets are written through a rebalancing shuffle: adaptive execution splits a
bucket that one key makes large over several files, and puts small ones together.
The driver reads a version's entries, one row a bucket.

Defined cases: rows without key share a bucket; a table without rows has no
entries; a version read keeps its files until ``expire`` removes what only older
versions hold; ``sweep`` removes what killed writers left.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators.changes import UPDATE, apply_changes, refuse_unordered_updates
from gleaner.operators.numbering import DELETE, INSERT, number_keyless
from gleaner.schema import KEYS
from gleaner.session import cut
from gleaner.sources.files import AlreadyThere, Files
from gleaner.tables import Tables

ENTRIES = "bucket int, commit string, rows long, top long"


class Conflict(Exception):
    """Other writers published first, more often than the batch was tried."""


@dataclass(frozen=True)
class Version:
    number: int
    entries: str  # the commit that wrote the version's entries; empty for a table without rows
    transactions: dict[str, int]


class VersionedTable:
    """A table under ``root`` keyed by ``keys``, with its schema and number of buckets fixed at creation."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: list[str], buckets: int):
        self.spark, self.root, self.schema, self.keys, self.buckets = spark, root, schema, keys, buckets
        self.files = Files(spark)

    @classmethod
    def create(cls, df: DataFrame, root: str, keys: str | list[str], buckets: int) -> VersionedTable:
        """A new table with the rows of ``df`` as its first version."""
        keys = [keys] if isinstance(keys, str) else list(keys)
        if "bucket" in [c.lower() for c in df.columns]:
            raise ValueError("a versioned table has no column named bucket")
        files = Files(df.sparkSession)
        layout = json.dumps({"schema": df.schema.jsonValue(), "keys": keys, "buckets": buckets})
        files.write_new(f"{root}/layout", layout, f"{root}/_tmp-{uuid.uuid4().hex}")
        table = cls(df.sparkSession, root, df.schema, keys, buckets)
        table.replace(df)
        return table

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> VersionedTable:
        layout = json.loads(Files(spark).read(f"{root}/layout"))
        return cls(spark, root, T.StructType.fromJson(layout["schema"]), layout["keys"], layout["buckets"])

    # Reading ----------------------------------------------------------------------------------

    def numbers(self) -> list[int]:
        """The versions that can be read, ascending."""
        return sorted(int(n) for n in self.files.names(f"{self.root}/versions") if n.isdigit())

    def version(self, number: int | None = None) -> Version | None:
        """A version, the newest by default; None before the first."""
        numbers = self.numbers()
        if not numbers:
            return None
        held = json.loads(self.files.read(self._version_path(numbers[-1] if number is None else number)))
        return Version(held["number"], held["entries"], held["transactions"])

    def _version_path(self, number: int) -> str:
        return f"{self.root}/versions/{number:012d}"

    def entries(self, version: Version | None) -> DataFrame:
        """(bucket, commit, rows, top) of each bucket with rows."""
        if version is None or not version.entries:
            return self.spark.createDataFrame([], ENTRIES)
        return self.spark.read.schema(ENTRIES).parquet(f"{self.root}/entries/{version.entries}")

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        version = self.version(number)
        return self._rows((r["bucket"], r["commit"]) for r in self.entries(version).collect())  # one row a bucket

    def _rows(self, held) -> DataFrame:
        paths = sorted(f"{self.root}/data/{commit}/bucket={bucket}" for bucket, commit in held)
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def row_count(self, number: int | None = None) -> int:
        """Rows of a version, from its entries."""
        return self.entries(self.version(number)).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def bucket_of(self, columns: list[str] | None = None) -> Column:
        return F.pmod(F.xxhash64(*(columns or self.keys)), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that the keys of ``rows`` fall in."""
        return sorted(r[0] for r in rows.select(self.bucket_of().alias("b")).distinct().collect())  # one row a bucket

    # Writing ----------------------------------------------------------------------------------

    def replace(self, df: DataFrame, transaction: tuple[str, int] | None = None, tries: int = 20) -> Version:
        """All rows at once: a full-replace load. Readers see the old rows until the new version is published."""
        return self._commit(lambda version: (df, None), transaction, tries)

    def apply(self, changes: DataFrame, transaction: tuple[str, int] | None = None, tries: int = 20,
              before_publishing: Callable[[], None] | None = None) -> Version:
        """The table after a batch of changes (``gleaner.operators.changes``), one statement after another.

        ``before_publishing`` runs once, when the first try has written its files (for tests of two writers).
        """
        (key,) = self.keys
        changes = cut(changes.withColumn("op", F.lower(F.trim("op"))), "changes")
        kinds, sets = self._kinds(changes)
        if UPDATE in kinds:
            refuse_unordered_updates(changes, key)

        def batch(version: Version) -> tuple[DataFrame, list[int]]:
            held = {r["bucket"]: r for r in self.entries(version).collect()}
            numbered = self._numbered(changes, key, held)
            touched = self.touched(numbered.where(F.col(key).isNotNull()))
            old = self._rows((b, held[b]["commit"]) for b in touched if b in held)
            if not kinds & {UPDATE, DELETE}:  # nothing to fold: the rows, and the new ones
                new = numbered.where((F.col("op") == INSERT) & F.col(key).isNotNull())
                return old.unionByName(new.select(*self.schema.names)), touched
            return apply_changes(old, numbered, key, new_ids=False, updatable=sets), touched

        return self._commit(batch, transaction, tries, before_publishing)

    def _kinds(self, changes: DataFrame) -> tuple[set[str], list[str]]:
        """The kinds of changes that a batch has, and the columns that its updates set."""
        some = changes.select("op", F.explode_outer(F.array_intersect(
            "set_columns", F.array(*map(F.lit, self.schema.names)))).alias("column")).distinct().collect()
        return ({r["op"] for r in some},  # a row a kind and column
                sorted({r["column"] for r in some if r["op"] == UPDATE and r["column"] is not None}))

    def _numbered(self, changes: DataFrame, key: str, held: dict) -> DataFrame:
        """``changes`` with ids for all inserts, from the keys that deletes may remove and the others' highest."""
        if not changes.where((F.col("op") == INSERT) & F.col(key).isNull()).limit(1).count():
            return changes
        deletes = changes.where((F.col("op") == DELETE) & F.col(key).isNotNull())
        seen = set(self.touched(deletes))
        top = max((r["top"] for b, r in held.items() if b not in seen and r["top"] is not None), default=None)
        keys = self._rows((b, held[b]["commit"]) for b in seen if b in held).select(key)
        if top is not None:
            keys = keys.unionByName(self.spark.range(1).select(F.lit(top).cast(self.schema[key].dataType).alias(key)))
        return cut(number_keyless(keys, changes, key), "numbered")

    def merge(self, delta: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame],
              transaction: tuple[str, int] | None = None, tries: int = 20) -> Version:
        """The buckets of ``delta``'s keys become ``combine(their rows, delta)``, whose keys fall in the same buckets."""
        delta = cut(delta, "delta")
        touched = self.touched(delta)

        def batch(version: Version) -> tuple[DataFrame, list[int]]:
            held = {r["bucket"]: r["commit"] for r in self.entries(version).where(F.col("bucket").isin(touched)).collect()}
            return combine(self._rows(held.items()), delta), touched

        return self._commit(batch, transaction, tries)

    def _commit(self, batch: Callable, transaction: tuple[str, int] | None, tries: int,
                before_publishing: Callable[[], None] | None = None) -> Version:
        for _ in range(tries):
            version = self.version()
            done = dict(version.transactions) if version else {}
            if transaction:
                if done.get(transaction[0], -1) >= transaction[1]:
                    return version  # a retried batch
                done[transaction[0]] = transaction[1]
            rows, touched = batch(version)
            commit = uuid.uuid4().hex
            if touched is None or touched:
                self._write(rows, commit)
            entries = self._write_entries(version, commit, touched)
            if before_publishing:
                before_publishing, hook = None, before_publishing
                hook()
            number = version.number + 1 if version else 0
            try:
                self.files.write_new(self._version_path(number), json.dumps(
                    {"number": number, "entries": entries, "transactions": done}), f"{self.root}/_tmp-{commit}")
                return Version(number, entries, done)
            except AlreadyThere:  # another writer was first: again, on top of its version
                self.files.delete(f"{self.root}/data/{commit}")
                self.files.delete(f"{self.root}/entries/{commit}")
        raise Conflict(f"{self.root}: {tries} tries")

    def _write(self, rows: DataFrame, commit: str) -> None:
        (rows.select(*self.schema.names).withColumn("bucket", self.bucket_of()).hint("rebalance", "bucket")
         .sortWithinPartitions("bucket", *self.keys).write.partitionBy("bucket").parquet(f"{self.root}/data/{commit}"))

    def _write_entries(self, version: Version | None, commit: str, touched: list[int] | None) -> str:
        """The buckets of the version to be: those just written, and the old version's others."""
        written = [n for n in self.files.names(f"{self.root}/data/{commit}") if n.startswith("bucket=")]
        numeric = len(self.keys) == 1 and isinstance(self.schema[self.keys[0]].dataType, (T.LongType, T.IntegerType))
        top = F.max(self.keys[0]).cast("long") if numeric else F.lit(None).cast("long")
        entries = self.spark.createDataFrame([], ENTRIES)
        if written:
            schema = T.StructType([*(self.schema[k] for k in self.keys), T.StructField("bucket", T.IntegerType())])
            entries = (self.spark.read.schema(schema).parquet(f"{self.root}/data/{commit}").groupBy("bucket")
                       .agg(F.lit(commit).alias("commit"), F.count(F.lit(1)).alias("rows"), top.alias("top")))
        if touched is not None:
            entries = entries.unionByName(self.entries(version).where(~F.col("bucket").isin(touched)))
        entries.coalesce(1).write.parquet(f"{self.root}/entries/{commit}")
        return commit

    # Differences ------------------------------------------------------------------------------

    def differing(self, old: int | None, new: int) -> tuple[DataFrame, DataFrame]:
        """The rows before and after, of the buckets that differ between two versions (None: before the first)."""
        before = {} if old is None else {r["bucket"]: r["commit"] for r in self.entries(self.version(old)).collect()}
        after = {r["bucket"]: r["commit"] for r in self.entries(self.version(new)).collect()}
        return (self._rows((b, c) for b, c in before.items() if after.get(b) != c),
                self._rows((b, c) for b, c in after.items() if before.get(b) != c))

    # Retention --------------------------------------------------------------------------------

    def expire(self, keep: int) -> None:
        """Keep the newest ``keep`` versions; what only older ones hold is deleted."""
        if keep < 1:
            raise ValueError("a table keeps one version at least")
        numbers = self.numbers()
        old, kept = numbers[:-keep], numbers[-keep:]

        def held(some: list[int]) -> set[tuple[int, str]]:
            return {(r["bucket"], r["commit"]) for n in some for r in self.entries(self.version(n)).collect()}

        kept_entries = {self.version(n).entries for n in kept}
        gone, old_entries = held(old) - held(kept), {self.version(n).entries for n in old} - kept_entries
        for n in old:
            self.files.delete(self._version_path(n))
        for bucket, commit in gone:
            self.files.delete(f"{self.root}/data/{commit}/bucket={bucket}")
        for commit in old_entries:
            self.files.delete(f"{self.root}/entries/{commit}")

    def sweep(self, before_ms: int) -> list[str]:
        """Delete commits that no version names and that are older than ``before_ms``: killed writers left them."""
        versions = [self.version(n) for n in self.numbers()]
        named = {v.entries for v in versions} | {r["commit"] for v in versions for r in self.entries(v).collect()}
        gone = []
        for part in ("data", "entries"):
            for commit, written in self.files.names(f"{self.root}/{part}").items():
                if commit not in named and written < before_ms:
                    self.files.delete(f"{self.root}/{part}/{commit}")
                    gone.append(commit)
        return sorted(set(gone))


# The four tables ------------------------------------------------------------------------------


def save_versioned(tables: Tables, root: str, buckets: int) -> None:
    """The four tables as versioned tables under ``root``: new ones, or a next version of those that are there."""
    spark = tables.providers.sparkSession
    for name, df in tables.by_name().items():
        path = f"{root}/{name}"
        if "layout" in Files(spark).names(path):
            VersionedTable.open(spark, path).replace(df)
        else:
            VersionedTable.create(df, path, KEYS[name], buckets)


def load_versioned(spark: SparkSession, root: str) -> Tables:
    """The newest version of each of the four tables."""
    t = {name: VersionedTable.open(spark, f"{root}/{name}").read() for name in KEYS}
    return Tables(t["providers"], t["receivers"], t["food_listings"], t["claims"])
