"""Exact dedup over a cuckoo-filter index of the live texts' digests.

**Index.** A text's key is its SHA-256. Keys are dealt to shards by their first
bits; a shard has a cuckoo filter (16-bit fingerprints, four slots a bucket, two
buckets a key) and its content: the live rows (shard, digest, id), stored sorted
by shard and digest, so that a reader of some shards skips the rest. Both are
Parquet tables under one folder, one folder for each version.

**Insertion.** Copies are combined within each task before they are shuffled, so
a text that a third of all rows hold is one row a task. A shard's keys go through
its filter: a key that misses is new for certain and its fingerprint is put in; a
key that hits is only a suspect and is verified against the content of its shard,
by its whole digest. Keys that never hit need no look at any content.

**Deletion.** Keys that miss cannot be there. Hits are verified against the stored
(digest, id) rows; what is found is removed, and the fingerprint of a digest
leaves the filter with its last live row.

**Overflow.** Where evictions find no room, the rest of the shard's keys count as
suspects, so nothing is lost, and the shard's filter is built anew, larger, from
its stored keys.

A shard's filter and keys are in memory in one task. Their number is bounded by
``SHARD_KEYS`` on average: the shards follow the number of rows, and an index
that has outgrown them is dealt to more shards from its stored keys.

Defined cases: NULL counts as the empty text; rows that share id and text are
copies like any other (each counts, and each is kept if its id is the group's
largest); rows without id are kept only where no copy has one; an empty table
gives an empty result; only the id and text columns are read, so others cannot
clash. Texts are read whole, and never leave the JVM.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.blocks import by_block, whole_groups
from gleaner.llm.lineage import cut, scratch

SLOTS = 4
#: Evictions one after another before a filter counts as full.
KICKS = 200
#: Keys a slot when a filter is built.
LOAD = 0.8
SHARD_KEYS = 1 << 17
LEAST_SHARDS = 64
#: Rows that a task combines at once.
COMBINE = 1 << 18
#: Groups of at least this part of all rows are joined by broadcast; there are at most as many.
HEAVY = 4096

ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


# The filter ---------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class CuckooFilter:
    """Fingerprints of 64-bit keys, ``SLOTS`` to a bucket; all operations take arrays of keys."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots.reshape(-1, SLOTS)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        """An empty filter with room for ``keys`` keys at ``LOAD``."""
        buckets = 1 << max(2, int(np.ceil(np.log2(max(keys, 1) / (SLOTS * LOAD)))))
        return cls(np.zeros(buckets * SLOTS, dtype=np.uint16))

    @classmethod
    def loads(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, dtype="<u2").astype(np.uint16))

    def dumps(self) -> bytes:
        return self.slots.astype("<u2").tobytes()

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (_mix(mark.astype(np.uint64)) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and the two buckets of each key."""
        spread = _mix(keys)
        mark = (spread >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (spread & np.uint64(len(self.slots) - 1)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be in; False is certain."""
        mark, first, second = self._places(keys)
        return (self.slots[first] == mark[:, None]).any(1) | (self.slots[second] == mark[:, None]).any(1)

    def put(self, keys: np.ndarray) -> bool:
        """Insert keys that are not in; False if the filter overflowed (some fingerprint is then left out)."""
        mark, bucket, other = self._places(keys)
        left = self._fill(mark, bucket)
        mark, bucket = mark[left], other[left]
        rng = np.random.default_rng(len(keys))
        for _ in range(KICKS):
            left = self._fill(mark, bucket)
            if not len(left):
                return True
            mark, bucket = mark[left], bucket[left]
            # One fingerprint of each full bucket makes room and goes to its other bucket.
            at, one = np.unique(bucket, return_index=True)
            slot = rng.integers(0, SLOTS, len(at))
            out = self.slots[at, slot]
            self.slots[at, slot] = mark[one]
            rest = np.ones(len(mark), dtype=bool)
            rest[one] = False
            mark, bucket = np.append(out, mark[rest]), np.append(self._other(at, out), bucket[rest])
        return False

    def _fill(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their buckets; the places of those that found none."""
        if not len(bucket):
            return bucket
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        run = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        nth = np.arange(len(b)) - np.repeat(run, np.diff(np.append(run, len(b))))
        free = self.slots[b] == 0
        fits = nth < free.sum(1)
        slot = np.argmax(np.cumsum(free, axis=1) > nth[:, None], axis=1)
        self.slots[b[fits], slot[fits]] = mark[order][fits]
        return order[~fits]

    def drop(self, keys: np.ndarray) -> None:
        """Take out one fingerprint of each key; the keys must be in."""
        for mark, first, second in zip(*self._places(keys)):
            for bucket in (first, second):
                at = np.flatnonzero(self.slots[bucket] == mark)
                if len(at):
                    self.slots[bucket, at[0]] = 0
                    break


def key_of(digests: pa.Array) -> np.ndarray:
    """The first eight bytes of each digest."""
    data = b"".join(digests.to_pylist())
    return np.frombuffer(data, dtype=">u8")[::4].astype(np.uint64)


# Index tables -------------------------------------------------------------------------------

def _shard(digest: str, shards: int):
    """The shard of a digest: a hash of it, so any number of shards is dealt evenly."""
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int").alias("shard")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest binary) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest"))


def combined(rows: DataFrame) -> DataFrame:
    """(digest, n, top): equal digests of a task's rows as one row, ``COMBINE`` rows at a time; no shuffle."""
    kind = rows.schema["id"].dataType.simpleString()

    def folded(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).group_by("digest").aggregate([("id", "max"), ([], "count_all")])
        t = t.select(["digest", "count_all", "id_max"]).rename_columns(["digest", "n", "top"])
        yield from t.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= COMBINE:
                yield from folded(held)
                held, n = [], 0
        if n:
            yield from folded(held)

    return rows.select("id", "digest").mapInArrow(run, f"digest binary, n long, top {kind}")


def _probe(batches: Iterator[pa.RecordBatch], insert: bool) -> Iterator[pa.RecordBatch]:
    """Rows of whole shards, the shard's filter first, with ``hit``; with ``insert`` also the filter afterwards.

    Rows in: shard, slots (filter rows only), keys (how many to expect), and any others; ``digest`` is NULL in filter rows.
    """
    for table, bounds in whole_groups(batches, ["shard"]):
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            group = table.slice(a, b - a)
            slots = group.column("slots").drop_null()
            rows = group.filter(pc.is_valid(group.column("digest"))).combine_chunks()
            keys = key_of(rows.column("digest")) if rows.num_rows else np.zeros(0, dtype=np.uint64)
            own = CuckooFilter.loads(slots[0].as_py()) if len(slots) else None
            full = False
            if insert:
                own = own or CuckooFilter.sized(len(keys))
                seen = pc.dictionary_encode(rows.column("digest")).combine_chunks().indices.to_numpy() \
                    if rows.num_rows else np.zeros(0, dtype=np.int64)
                first = np.zeros(len(keys), dtype=bool)
                first[np.unique(seen, return_index=True)[1]] = True
                hit = np.ones(len(keys), dtype=bool)  # a copy of an earlier row of the batch hits
                at = np.flatnonzero(first)
                for lo in range(0, len(at), 4096):  # keys put in earlier are seen by later ones
                    part = at[lo:lo + 4096]
                    if full:
                        break  # suspects, all of them
                    new = part[~own.has(keys[part])]
                    # Two keys of one fingerprint in a piece: only the first may go in as certainly new.
                    mark, one, two = own._places(keys[new])
                    pair = mark.astype(np.int64) * len(own.slots) + np.minimum(one, two)
                    new = new[np.sort(np.unique(pair, return_index=True)[1])]
                    hit[new] = False
                    full = not own.put(keys[new])
            else:
                hit = own.has(keys) if own is not None else np.zeros(len(keys), dtype=bool)
            kept = [c for c in rows.column_names if c not in ("slots", "full")]
            out = rows.select(kept).append_column("hit", pa.array(hit))
            blank = out.num_rows
            yield from out.append_column("slots", pa.nulls(blank, pa.binary())).append_column(
                "full", pa.nulls(blank, pa.bool_())).combine_chunks().to_batches()
            if insert:
                line = {c: pa.nulls(1, out.schema.field(c).type) for c in kept + ["hit"]}
                line["shard"] = pa.array([group.column("shard")[0].as_py()], pa.int32())
                yield pa.RecordBatch.from_pydict(line | {"slots": pa.array([own.dumps()], pa.binary()),
                                                         "full": pa.array([full])})


def _through(filters: DataFrame | None, rows: DataFrame, insert: bool) -> DataFrame:
    """``rows`` (shard, digest, others) with ``hit`` by their shards' filters, and the filters afterwards (digest NULL)."""
    rows = rows.withColumn("slots", F.lit(None).cast("binary"))
    if filters is not None:
        touched = rows.select("shard").distinct()
        rows = rows.unionByName(filters.join(touched, "shard", "left_semi").select("shard", "slots"),
                                allowMissingColumns=True)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "slots")
    return by_block(rows, ["shard"]).mapInArrow(functools.partial(_probe, insert=insert),
                                                f"{kinds}, hit boolean, slots binary, full boolean")


def _rebuilt(content: DataFrame) -> DataFrame:
    """Filters with room to spare from the distinct stored keys of shards (shard, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["shard"]):
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                group = table.slice(a, b - a).combine_chunks()
                keys = np.unique(key_of(group.column("digest")))
                room = 2 * len(keys)
                while True:
                    own = CuckooFilter.sized(room)
                    if own.put(keys):
                        break
                    room *= 2
                yield pa.RecordBatch.from_pydict({"shard": pa.array([group.column("shard")[0].as_py()], pa.int32()),
                                                  "slots": pa.array([own.dumps()], pa.binary())})

    return by_block(content.select("shard", "digest").distinct(), ["shard"]).mapInArrow(run, "shard int, slots binary")


@dataclass
class CuckooIndex:
    """A version of the index: ``content`` (shard, digest, id) and ``filters`` (shard, slots) under ``path``."""

    spark: SparkSession
    path: str
    shards: int

    @property
    def content(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/content")

    @property
    def filters(self) -> DataFrame:
        return self.spark.read.schema("shard int, slots binary").parquet(f"{self.path}/filters")


def shards_for(rows: int) -> int:
    return max(LEAST_SHARDS, -(-rows // SHARD_KEYS))


def _store(spark: SparkSession, content: DataFrame, filters: DataFrame, shards: int, path: str) -> CuckooIndex:
    (content.select("shard", "digest", "id").repartitionByRange("shard", "digest", "id")
     .sortWithinPartitions("shard", "digest").write.parquet(f"{path}/content"))
    filters.select("shard", "slots").write.parquet(f"{path}/filters")
    return CuckooIndex(spark, path, shards)


def _entered(rows: DataFrame, shards: int, filters: DataFrame | None = None) -> DataFrame:
    """(shard, digest, n, top, hit) of combined rows after insertion, and the filters they leave."""
    dealt = combined(rows).select(_shard("digest", shards), "digest", "n", "top")
    return cut(_through(filters, dealt, insert=True), "entered")


def insert(docs: DataFrame, index: CuckooIndex | None = None, id_col: str = "doc_id",
           text_col: str = "text") -> CuckooIndex:
    """The index with the rows of ``docs`` added."""
    spark = docs.sparkSession
    rows = cut(digests(docs, id_col, text_col), "digests")
    n, old = rows.count(), index.content.count() if index else 0
    if index and shards_for(n + old) > 2 * index.shards:
        index = _redealt(index, 2 * shards_for(n + old))
    shards = index.shards if index else shards_for(n)
    entered = _entered(rows, shards, index.filters if index else None)
    new = rows.select(_shard("digest", shards), "digest", "id")
    content = cut(new.unionByName(index.content) if index else new, "content")
    # Suspects that verify as new keys share their fingerprint with another key: it goes in once more for them.
    entries = entered.where("digest IS NOT NULL")
    known = entries.where("NOT hit").select("shard", "digest")
    known = known.unionByName(index.content.select("shard", "digest")) if index else known
    twins = entries.where("hit").select("shard", "digest").distinct().join(known, ["shard", "digest"], "left_anti")
    made = cut(_edited(entered.where("NOT full").select("shard", "slots"), twins, put=True), "filters")
    full = entered.where("full").select("shard").unionByName(made.where("full").select("shard"))
    filters = made.where("NOT full").select("shard", "slots").unionByName(
        _rebuilt(content.join(full, "shard", "left_semi")))
    if index:
        filters = filters.unionByName(index.filters.join(filters.select("shard"), "shard", "left_anti"))
    return _store(spark, content, filters, shards, scratch(spark, "cuckoo"))


def _edited(filters: DataFrame, keys: DataFrame, put: bool) -> DataFrame:
    """``filters`` (shard, slots) and whether they overflowed, with the ``keys`` (shard, digest) put in or taken out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["shard"]):
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                group = table.slice(a, b - a)
                slots = group.column("slots").drop_null()
                if not len(slots):  # a filter that is built anew
                    continue
                own, full = CuckooFilter.loads(slots[0].as_py()), False
                digests_ = group.column("digest").drop_null()
                if len(digests_):
                    done = (own.put if put else own.drop)(key_of(digests_))
                    full = put and not done
                yield pa.RecordBatch.from_pydict({"shard": pa.array([group.column("shard")[0].as_py()], pa.int32()),
                                                  "slots": pa.array([own.dumps()], pa.binary()),
                                                  "full": pa.array([full])})

    return by_block(filters.unionByName(keys, allowMissingColumns=True), ["shard"]).mapInArrow(
        run, "shard int, slots binary, full boolean")


def _redealt(index: CuckooIndex, shards: int) -> CuckooIndex:
    """The same keys in more shards, from the stored content."""
    content = index.content.select(_shard("digest", shards), "digest", "id")
    return _store(index.spark, content, _rebuilt(content), shards, scratch(index.spark, "cuckoo"))


def delete(docs: DataFrame, index: CuckooIndex, id_col: str = "doc_id", text_col: str = "text") -> CuckooIndex:
    """The index without the rows of ``docs`` (id and text alike); rows that it does not hold change nothing."""
    spark = index.spark
    asked = digests(docs, id_col, text_col).select(_shard("digest", index.shards), "digest", "id").distinct()
    hits = cut(_through(index.filters, asked, insert=False).where("hit").select("shard", "digest", "id"), "hits")
    same = [F.col("c.shard") == F.col("h.shard"), F.col("c.digest") == F.col("h.digest"),
            F.col("c.id").eqNullSafe(F.col("h.id"))]
    gone = cut(index.content.alias("c").join(hits.alias("h"), same, "left_semi"), "gone")
    left = cut(index.content.alias("c").join(hits.alias("h"), same, "left_anti"), "left")
    dead = gone.select("shard", "digest").distinct().join(left, ["shard", "digest"], "left_anti")

    touched = dead.select("shard").distinct()
    changed = _edited(index.filters.join(touched, "shard", "left_semi"), dead, put=False)
    filters = changed.select("shard", "slots").unionByName(index.filters.join(touched, "shard", "left_anti"))
    return _store(spark, left, filters, index.shards, scratch(spark, "cuckoo"))


def lookup(docs: DataFrame, index: CuckooIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, live) of every row of ``docs``: how many live rows of the index hold its text (0: none)."""
    rows = cut(digests(docs, id_col, text_col), "digests")
    asked = rows.select(_shard("digest", index.shards), "digest").distinct()
    hits = _through(index.filters, asked, insert=False).where("hit").select("shard", "digest")
    live = index.content.join(hits, ["shard", "digest"], "left_semi").groupBy("digest").agg(
        F.count(F.lit(1)).alias("live"))
    return _attached(rows, live, "live", rows.count()).select(
        "id", "digest", F.coalesce("live", F.lit(0)).alias("live"))


# Dedup --------------------------------------------------------------------------------------


def _attached(rows: DataFrame, groups: DataFrame, size: str, total: int) -> DataFrame:
    """``rows`` and the columns of their digest's group, NULL without one.

    Groups with a ``HEAVY``-th of ``total`` rows or more, at most ``HEAVY`` of them, come by broadcast; so no
    key of the shuffled join has more rows than that.
    """
    groups = cut(groups, "groups")
    big = F.col(size) * HEAVY >= max(total, HEAVY)
    named = [c for c in groups.columns if c != "digest"]
    first = rows.join(F.broadcast(groups.where(big)), "digest", "left")
    rest = first.where(F.col(size).isNull()).drop(*named).join(groups.where(~big), "digest", "left")
    return first.where(F.col(size).isNotNull()).unionByName(rest)


def groups_of(rows: DataFrame, shards: int) -> DataFrame:
    """(digest, n, top) of every digest that more than one of ``rows`` (id, digest) has.

    Digests that hit in their shard's filter are suspects; all entries of a suspect are put together by the whole
    digest. Other digests have one entry, which is their group.
    """
    entries = _entered(rows, shards).where("digest IS NOT NULL")
    suspects = entries.where("hit").select("shard", "digest").distinct()
    # A hit of the first key with its fingerprint's places leaves that key's own entry unmarked, so all are looked at.
    verified = entries.join(suspects, ["shard", "digest"], "left_semi").groupBy("digest").agg(
        F.sum("n").alias("n"), F.max("top").alias("top"))
    alone = entries.join(suspects, ["shard", "digest"], "left_anti").select("digest", "n", "top")
    return verified.unionByName(alone).where("n > 1")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row: the row with the largest id of equal texts stays."""
    rows = cut(digests(docs, id_col, text_col), "digests")
    total = rows.count()
    found = _attached(rows, groups_of(rows, shards_for(total)), "n", total)
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("top"))
    return found.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
