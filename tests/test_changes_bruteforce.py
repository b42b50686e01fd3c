"""apply_changes against a statement-by-statement simulation (brute force).

300 random scenarios, each on its own key range so that one Spark job checks
them all: existing rows (keys may repeat), then inserts (duplicate keys
allowed), partial updates (NULL can be set) and deletes in random order.
"""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators.changes import apply_changes
from gleaner.operators.numbering import Alive, number_keyless
from gleaner.schema import PROVIDERS, change_schema

COLS = ["Name", "Type", "Address", "City", "Contact"]
POOL = {"Name": ["A", "B", None], "Type": ["NGO", "Other", None], "Address": ["x", None],
        "City": ["Goa", "Pune", None], "Contact": ["a@b", "1", None]}


def random_row(rng, key):
    return {"Provider_ID": key, **{c: rng.choice(POOL[c]) for c in COLS}}


def scenario(rng, base_key, seq0):
    keys = [base_key + i for i in range(3)]
    table = [random_row(rng, rng.choice(keys)) for _ in range(rng.randint(0, 4))]
    changes = []
    for s in range(rng.randint(1, 8)):
        k = rng.choice(keys)
        op = rng.choice(["insert", "update", "update", "delete"])
        row = random_row(rng, k)
        sets = rng.sample(COLS, rng.randint(1, 3)) if op == "update" else None
        changes.append((op, seq0 + s, row, sets))
    return table, changes


def simulate(table, changes):
    rows = [dict(r) for r in table]
    for op, _, row, sets in sorted(changes, key=lambda c: c[1]):
        k = row["Provider_ID"]
        if op == "insert":
            rows.append(dict(row))
        elif op == "delete":
            rows = [r for r in rows if r["Provider_ID"] != k]
        else:
            for r in rows:
                if r["Provider_ID"] == k:
                    for c in sets:
                        r[c] = row[c]
    return rows


def as_tuple(r):
    return tuple(r[c] for c in ["Provider_ID"] + COLS)


def test_fold_matches_sequential_semantics(spark):
    rng = random.Random(11)
    tables, changes, expected = [], [], []
    for i in range(300):
        t, ch = scenario(rng, 1000 * (i + 1), 10 * i)
        tables += t
        changes += ch
        expected += simulate(t, ch)
    base = spark.createDataFrame([as_tuple(r) for r in tables], PROVIDERS)
    ch_rows = [(op, seq, *as_tuple(row), sets) for op, seq, row, sets in changes]
    ch_df = spark.createDataFrame(ch_rows, change_schema("providers"))
    got = apply_changes(base, ch_df, "Provider_ID", new_ids=False).collect()
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted((as_tuple(r) for r in expected), key=key)


def number_one_by_one(table, changes):
    """The simulation with ids for keyless inserts: the highest id alive, plus one."""
    rows = [dict(r) for r in table]
    for op, _, row, sets in sorted(changes, key=lambda c: c[1]):
        row = dict(row)
        if op == "insert" and row["Provider_ID"] is None:
            row["Provider_ID"] = max((r["Provider_ID"] for r in rows), default=0) + 1
        rows = simulate(rows, [(op, 0, row, sets)])
    return rows


def sorted_rows(rows):
    return sorted(rows, key=lambda r: tuple("" if v is None else str(v) for v in r))


def test_keyless_inserts_between_other_changes(spark):
    rng = random.Random(3)
    lowered = 0
    for _ in range(14):
        table = [random_row(rng, rng.randint(1, 6)) for _ in range(rng.randint(0, 4))]
        changes = []
        for s in range(rng.randint(3, 8)):
            op = rng.choice(["insert", "insert", "insert", "update", "delete", "delete"])
            key = None if op == "insert" and rng.random() < 0.7 else rng.randint(1, 9)
            changes.append((op, s, random_row(rng, key), rng.sample(COLS, 2) if op == "update" else None))
        base = spark.createDataFrame([as_tuple(r) for r in table], PROVIDERS)
        ch_df = spark.createDataFrame([(op, seq, *as_tuple(row), sets) for op, seq, row, sets in changes],
                                      change_schema("providers"))
        keyless = [c[1] for c in changes if c[0] == "insert" and c[2]["Provider_ID"] is None]
        got = apply_changes(base, ch_df, "Provider_ID").collect()
        assert sorted_rows(tuple(r) for r in got) == sorted_rows(as_tuple(r) for r in number_one_by_one(table, changes))
        lowered += any(c[0] == "delete" and min(keyless, default=99) < c[1] < max(keyless, default=0) for c in changes)
    assert lowered >= 5


def ids_one_by_one(keys, statements):
    """The ids that keyless inserts get, by seq; statements are (seq, op, id)."""
    alive, out = list(keys), {}
    for seq, op, v in sorted(statements, key=lambda c: (c[0], c[1] == "delete", c[2] is not None)):
        if op == "insert":
            if v is None:
                v = out[seq] = max(alive, default=0) + 1
            alive.append(v)
        else:
            alive = [k for k in alive if k != v]
    return out


def test_walk_of_many_statements_equals_one_at_a_time():
    """The summaries alone, without Spark: stretches of new ids between critical statements."""
    rng = random.Random(5)
    for _ in range(3000):
        keys = [rng.randint(-3, 9) for _ in range(rng.randint(0, 5))]
        statements = [(s, *rng.choice([("insert", None), ("insert", None), ("insert", rng.randint(-4, 14)),
                                       ("delete", rng.randint(-4, 14))])) for s in range(rng.randint(1, 14))]
        doomed = {v for _, op, v in statements if op == "delete"}
        floor = max((k for k in keys if k not in doomed), default=None)
        state = Alive(floor, {k for k in keys if k in doomed and (floor is None or k > floor)}, doomed)
        got, run = {}, []
        for s, op, v in statements + [(None, "end", 0)]:
            if op == "insert" and v is None:
                run.append(s)
                continue
            if run:
                start = state.give(len(run))
                got |= {k: start + i + 1 for i, k in enumerate(run)}
                run = []
            if op == "insert":
                state.add(v)
            elif op == "delete":
                state.drop(v)
        assert got == ids_one_by_one(keys, statements)


@pytest.mark.parametrize("block", [1, 40, 10**6])
def test_ids_of_a_batch_that_deletes_what_it_inserts(spark, block):
    rng = random.Random(block)
    keys = [rng.randint(1, 60) for _ in range(40)]
    statements, top = [], max(keys)
    for s in range(400):
        kind = rng.random()
        statements.append((s // 2, "insert", None) if kind < 0.55 else (s // 2, "insert", rng.randint(1, top + 60))
                          if kind < 0.62 else (s // 2, "delete", top + rng.randint(-30, 60)))
    unique = list(dict.fromkeys(s for s in statements))  # one keyless insert a seq, so that each has one id
    base = spark.createDataFrame([(k,) for k in keys], "id long")
    ch = spark.createDataFrame([(s, op, v) for s, op, v in unique], "seq long, op string, id long").repartition(5)
    got = number_keyless(base, ch.withColumn("was_new", F.col("id").isNull()), "id", block)
    want = ids_one_by_one(keys, unique)
    assert {r["seq"]: r["id"] for r in got.where("was_new").collect()} == want
    assert got.count() == len(unique) and got.where("id IS NULL").count() == 0


def test_ids_without_anything_alive_begin_at_one(spark):
    base = spark.createDataFrame([(4,)], "id long")
    ch = spark.createDataFrame([(0, "delete", 4), (1, "insert", None), (2, "delete", 1), (3, "insert", None),
                                (4, "insert", None), (5, "delete", None)], "seq long, op string, id long")
    got = number_keyless(base, ch, "id").where("op = 'insert'").collect()
    assert {r["seq"]: r["id"] for r in got} == {1: 1, 3: 1, 4: 2}


def test_a_block_holds_only_ids_that_later_ones_delete():
    """Ids that were deleted for the last time raise the floor, so that the state between blocks stays small."""
    import pyarrow as pa

    from gleaner.operators import numbering as N

    names = ["part", "pid", "stretch", "drops", "value", "n"]
    rows = [(N.FLOOR, None, None, None, 10, None)]
    rows += [(N.DOOMED, None, None, v > 60, v, None) for v in range(12, 62)]  # 61 is deleted in a later block, too
    rows += [(N.STRETCH, 0, 0, None, None, 2)] + [(N.STRETCH, 0, k, True, 11 + k, 2) for k in range(1, 50)]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    out = [r for b in N._walk(iter([batch])) for r in b.to_pylist()]
    assert [r["value"] for r in out if r["part"] == N.STRETCH] == [10 + k for k in range(50)]
    assert [(r["part"], r["value"]) for r in out if r["part"] != N.STRETCH] == [(N.FLOOR, 60), (N.ALIVE, 61)]
