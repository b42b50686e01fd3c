"""Ids of inserts without one, as one statement after another would give them.

A keyless insert gets the highest id alive at its turn, plus one. A batch may
delete ids between such inserts, also those that it has just given, which lowers
later ids again; so what counts is, at any turn, the highest id alive.

Most of that needs no order at all. An id that no statement of the batch deletes
lives on once it is there: the highest such id of the table is a **floor**, and
deletes and keyed inserts at or below it change nothing. What is left is
**critical**: deletes and keyed inserts above the floor. Between two critical
statements, keyless inserts get consecutive ids, so a whole stretch of them is
summarised by its length. Statements are sorted once, by range; every partition
reduces its own to stretches (a distributed aggregate), and only these, one row a
critical statement and a partition, are walked in order.

The walk holds the floor and the ids above it that are alive; ids given that
nobody deletes any more raise the floor, so only ids that some statement still to
come deletes are ever held. It goes on in blocks of ``BLOCK`` stretches, one task
each, the state of a block written for the next. A block reads its own stretches
and, of the ids deleted, those that it can meet: deleted in it or later, above its
floor, and not above the highest id that it can give. Both are stored in order, so
that a block reads no more than that: memory is bounded by a block and the ids
alive that are still to be deleted, and the time of all blocks grows with the
batch. Then every insert's id is its stretch's start plus its place in it, by a
join.

Defined cases: with nothing alive the first id is 1; of statements with equal
``seq`` inserts come before deletes and those without id first; deletes without id
do nothing; several rows of one id go with one delete.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.session import cut, scratch, workers_find_package

INSERT, DELETE = "insert", "delete"
#: Stretches that one task walks.
BLOCK = 1_000_000
#: New ids that are looked up one by one among those that statements delete.
SHORT = 16

FLOOR, ALIVE, DOOMED, STRETCH = range(4)  # in the order in which a task reads them
WALK = "part int, pid int, stretch long, drops boolean, value long, n long"


class Alive:
    """The ids alive at a turn, as far as they can matter: a floor that lives on, and those above it."""

    def __init__(self, floor: int | None = None, above=(), doomed=()):
        self.floor = floor
        self.above = set(above)
        self.heap = [-v for v in self.above]
        heapq.heapify(self.heap)
        self.doomed = sorted(doomed)  # ids that some statement of the batch deletes
        self.known = set(self.doomed)

    def highest(self) -> int | None:
        while self.heap and (-self.heap[0] not in self.above or self._under(-self.heap[0])):
            self.above.discard(-heapq.heappop(self.heap))
        return -self.heap[0] if self.heap else self.floor

    def _under(self, value: int) -> bool:
        return self.floor is not None and value <= self.floor

    def drop(self, value: int) -> None:
        self.above.discard(value)

    def add(self, value: int) -> None:
        if self._under(value):
            return
        if value not in self.known:
            self.floor = value
        elif value not in self.above:
            self.above.add(value)
            heapq.heappush(self.heap, -value)

    def give(self, n: int) -> int:
        """The start of ``n`` consecutive new ids: the first is the start plus one."""
        start = self.highest() or 0
        if n <= SHORT:
            lasting = start + n
            while lasting > start and lasting in self.known:
                lasting -= 1
            self._given(start, lasting, n)
            return start
        among = self.doomed[bisect_left(self.doomed, start + 1):bisect_right(self.doomed, start + n)]
        lasting = start + n  # the highest of the new ids that nobody deletes
        while among and among[-1] == lasting:
            lasting -= 1
            among.pop()
        self._given(start, lasting, n)
        return start

    def _given(self, start: int, lasting: int, n: int) -> None:
        if lasting > start:
            self.add(lasting)
        for value in range(lasting + 1, start + n + 1):
            self.add(value)

    def held(self) -> list[int]:
        self.highest()
        return [v for v in self.above if not self._under(v)]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The starts of a block's stretches, and the floor and ids alive after it.

    Of the ids deleted, those that a later block deletes too have ``drops`` set.
    """
    floor, above, doomed, later, alive = None, [], [], set(), None
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
    names = ["part", "pid", "stretch", "drops", "value", "n"]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        starts = []
        for part, pid, stretch, drops, value, n in zip(*(batch.column(c).to_pylist() for c in names)):
            if part == STRETCH:
                alive = alive or Alive(floor, above, doomed)
                if drops is not None:
                    (alive.drop if drops else alive.add)(value)
                if n:
                    starts.append((STRETCH, pid, stretch, None, alive.give(n), n))
            elif part == FLOOR:
                floor = value
            elif part == ALIVE:
                above.append(value)
            else:
                doomed.append(value)
                if drops:
                    later.add(value)
        if starts:
            yield packed(starts)
    if alive:
        held = alive.held()
        lasting = [v for v in held if v not in later]  # nobody deletes them after this block
        floor = max([*lasting, *([] if alive.floor is None else [alive.floor])], default=None)
        state = [(FLOOR, None, None, None, floor, None)]
        state += [(ALIVE, None, None, None, v, None) for v in held if v in later and (floor is None or v > floor)]
        for at in range(0, len(state), 10_000):
            yield packed(state[at:at + 10_000])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Statements in order, with their partition, the stretch in it and, of keyless inserts, the place in the stretch."""
    pid, stretch, nth = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        opens = batch.column("_rank").to_numpy(zero_copy_only=False) > 0
        at = stretch + np.cumsum(opens)
        count = np.cumsum(~opens) + nth  # keyless inserts since the open stretch began
        before = np.maximum.accumulate(np.where(opens, count, 0))
        place = count - before
        stretch, nth = int(at[-1]), int(place[-1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(at), pid, dtype=np.int32)), pa.array(at.astype(np.int64)),
             pa.array(place.astype(np.int64))], names=[*batch.schema.names, "_pid", "_stretch", "_nth"])


def _rows(df: DataFrame, part: int, value: str) -> DataFrame:
    return df.select(F.lit(part).alias("part"), F.col(value).cast("long").alias("value"))


def _blocks(counts: list[tuple[int, int]], limit: int) -> Iterator[tuple[int, int]]:
    """First and last partition of each block: consecutive ones with at most ``limit`` stretches, or a single one."""
    first = held = None
    for pid, n in counts:
        if first is not None and held + n > limit:
            yield first, last
            first = None
        if first is None:
            first, held = pid, 0
        held, last = held + n, pid
    if first is not None:
        yield first, last


def number_keyless(df: DataFrame, changes: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """``changes`` (``op`` in small letters, ``seq``, the columns of ``df``) with an id for every insert without one.

    Runs while the DataFrame is built: the statements' places are written, and each block of stretches is a job.
    """
    spark = df.sparkSession
    op, seq = F.col("op"), F.col("seq")
    new = (op == INSERT) & F.col(key).isNull()
    last = changes.where(new).agg(F.max("seq")).first()[0]  # one number
    if last is None:
        return changes
    workers_find_package(spark)
    drops = changes.where((op == DELETE) & F.col(key).isNotNull() & (seq < last)).select(key).distinct()
    floor = df.select(key).join(drops, key, "left_anti").agg(F.max(key)).first()[0]  # one number
    above = F.lit(True) if floor is None else F.col(key) > floor

    rank = F.when(new, 0).when(op == INSERT, 1).otherwise(2)
    matters = new | (F.col(key).isNotNull() & above & (seq < last) & op.isin(INSERT, DELETE))
    # The last sort key tells statements of one seq apart, so that the range partitioner can split many of them.
    staged = (changes.where(matters).withColumn("_rank", rank).withColumn("_tie", F.monotonically_increasing_id())
              .orderBy("seq", "_rank", "_tie").drop("_tie"))
    # Lists pass the Python workers as JSON, which is several times as fast.
    lists = {f.name: f.dataType for f in staged.schema if isinstance(f.dataType, T.ArrayType)}
    staged = staged.withColumns({c: F.to_json(c) for c in lists})
    pos = cut(staged.mapInArrow(_places, T.StructType([
        *staged.schema, T.StructField("_pid", T.IntegerType()), T.StructField("_stretch", T.LongType()),
        T.StructField("_nth", T.LongType())])), "places")
    opens = F.col("_rank") > 0  # a stretch begins with at most one critical statement
    stretches = cut(pos.groupBy(F.col("_pid").alias("pid"), F.col("_stretch").alias("stretch")).agg(
        F.max(F.when(opens, F.col("_rank") == 2)).alias("drops"),
        F.max(F.when(opens, F.col(key).cast("long"))).alias("value"),
        F.count(F.when(~opens, 1)).alias("n")).withColumn("part", F.lit(STRETCH))
        .repartitionByRange("pid", "stretch").sortWithinPartitions("pid", "stretch"), "stretches")
    doomed = cut(pos.where("_rank = 2").groupBy(F.col(key).cast("long").alias("value")).agg(F.max("_pid").alias("until"))
                 .repartitionByRange("value").sortWithinPartitions("value"), "doomed")

    state = _rows(df.where(above).join(drops, key, "left_semi").select(key).distinct(), ALIVE, key).unionByName(
        spark.range(1).select(F.lit(FLOOR).alias("part"), F.lit(floor).cast("long").alias("value")))
    state = cut(state, "alive")
    per = {r["pid"]: r for r in stretches.groupBy("pid").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").alias("new"),
        F.max(F.when(~F.col("drops"), F.col("value"))).alias("keyed")).collect()}  # one row a partition
    folder, paths = scratch(spark, "walked"), []
    for low, high in _blocks(sorted((pid, r["rows"]) for pid, r in per.items()), block):
        at = state.agg(F.max(F.when(F.col("part") == FLOOR, F.col("value"))).alias("floor"), F.max("value").alias("top")).first()
        mine = [r for pid, r in per.items() if low <= pid <= high]
        reach = max([at["top"] or 0, 0, *(r["keyed"] for r in mine if r["keyed"] is not None)]) + sum(r["new"] for r in mine)
        met = doomed.where((F.col("until") >= low) & (F.col("value") <= reach))
        if at["floor"] is not None:
            met = met.where(F.col("value") > at["floor"])
        met = met.select(F.lit(DOOMED).alias("part"), "value", (F.col("until") > high).alias("drops"))
        rows = (state.unionByName(met, allowMissingColumns=True)
                .unionByName(stretches.where(F.col("pid").between(low, high)), allowMissingColumns=True))
        paths.append(f"{folder}/{low}")
        (rows.select("part", "pid", "stretch", "drops", "value", "n").repartition(1)
         .sortWithinPartitions("part", "pid", "stretch").mapInArrow(_walk, WALK).write.parquet(paths[-1]))
        state = spark.read.schema(WALK).parquet(paths[-1]).where(F.col("part") != STRETCH).select("part", "value")
    starts = (spark.read.schema(WALK).parquet(*paths).where(F.col("part") == STRETCH)
              .select("pid", "stretch", F.col("value").alias("_start")))

    numbered = (pos.where("_rank = 0").join(starts, [F.col("_pid") == F.col("pid"), F.col("_stretch") == F.col("stretch")])
                .withColumn(key, (F.col("_start") + F.col("_nth")).cast(df.schema[key].dataType))
                .withColumns({c: F.from_json(c, kind) for c, kind in lists.items()}))
    return changes.where(~new | new.isNull()).unionByName(numbered.select(*changes.columns))
