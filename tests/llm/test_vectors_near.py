import random

import numpy as np
from pyspark.sql import functions as F

from gleaner.llm import blocks, components, order_minhash, queries, sign_hash
from tests.llm.common import SMALL, no_docs, odd_docs, random_words, rows_of


def groups(edges, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_equal_union_find(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    edges += [(1000, k) for k in range(1001, 1200)] + edges[:20]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == groups([e for e in edges if e[0] != e[1]], nodes)


def test_no_edges_no_components(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_every_pair_of_a_large_bucket_meets_in_one_block(spark):
    rows = spark.createDataFrame([(k % 2, k) for k in range(61)] + [(7, 99)], "bucket int, id long")
    got = blocks.in_blocks(rows, ["bucket"], "id", block=8).collect()
    meet = {}
    by = {}
    for r in got:
        by.setdefault((r["bucket"], r["low"], r["high"]), []).append(r)
    for (_, low, high), part in by.items():
        assert len(part) <= 40
        for x in part:
            for y in part:
                if x["id"] < y["id"] and (low == high or x["chunk"] != y["chunk"]):
                    meet[x["id"], y["id"]] = meet.get((x["id"], y["id"]), 0) + 1
    assert meet == {(a, b): 1 for a in range(61) for b in range(a + 1, 61) if a % 2 == b % 2}


def planted_vectors(seed=3):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(40):
            base = rng.standard_normal(16)
            for noise in (0, 0, 0.02, 0.05, 0.2, 1.0)[:rng.integers(1, 7)]:
                rows.append((k, [float(np.float32(x)) for x in base * rng.uniform(0.5, 2) + noise * rng.standard_normal(16)],
                             label))
                k += 1
    rows += [(k, None, 0), (k + 1, [0.0] * 16, 0), (k + 2, [1.0, None] + [0.0] * 14, 0), (k + 3, [float("nan")] * 16, 0),
             (k + 4, [float("inf")] + [1.0] * 15, 0), (k + 5, [], 0), (k + 6, [1.0, 2.0], 0), (k + 7, [1.0, 2.0], 0)]
    rows += [(k + 8 + j, rows[0][1], 0) for j in range(30)]
    return rows


def brute_vectors(rows):
    def ok(v, label):
        return label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)

    edges, links = [], {r[0]: 0 for r in rows}
    good = [(i, np.array(v, dtype=np.float64), label) for i, v, label in rows if ok(v, label)]
    for x, (i, v, label) in enumerate(good):
        for j, w, other in good[x + 1:]:
            if label == other and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= 0.98:
                edges.append((i, j))
                links[i] += 1
                links[j] += 1
    comp = groups(edges, links)
    return sorted((i, links[i], comp[i], comp[i] == i) for i in links)


def test_vectors_equal_brute_force(spark, monkeypatch):
    rows = planted_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr(
        "*", "1 AS t", "'x' AS key", "2 AS rep", "0 AS links", "0 AS kept")
    want = brute_vectors([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label)
                          for i, v, label in rows])
    assert rows_of(sign_hash.near_vectors(df)) == sorted(want, key=repr)
    monkeypatch.setattr(sign_hash, "BLOCK", 4)  # buckets in many blocks
    assert rows_of(sign_hash.near_vectors(df)) == sorted(want, key=repr)


def test_op5_on_embeddings_with_planted_links_equals_brute_force(spark, tmp_path):
    """The registered query over the table ``embeddings`` and near copies of its own vectors."""
    table = queries.table(spark, SMALL, "embeddings")
    rng, rows = np.random.default_rng(7), [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]
    top = max(r[0] for r in rows)
    for k, (_, v, label) in enumerate(rows[:60]):
        for c in range(k % 4):
            near = np.array(v) + rng.standard_normal(len(v)) * np.linalg.norm(v) / len(v) ** 0.5 * 0.12 * c
            rows.append((top + 1 + 4 * k + c, [float(np.float32(x)) for x in near], label))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(
        str(tmp_path / "embeddings.parquet"))
    want = brute_vectors(rows)
    assert sum(r[1] > 0 for r in want) > 60
    assert rows_of(queries.op5_sign_hash(spark, str(tmp_path))) == sorted(want, key=repr)


def test_vectors_are_not_shipped_to_every_table():
    """Vectors without likeness seldom share a bucket, so few bring their vector to one."""
    rng = np.random.default_rng(1)
    n = 2000
    bits, tables = sign_hash.plan(n)
    keys = (rng.standard_normal((n, 64)) @ sign_hash.planes(64, bits, tables) > 0).reshape(n, tables, bits) @ (
        1 << np.arange(bits))
    shared = 0
    for t in range(tables):
        times = np.unique(keys[:, t], return_counts=True)[1]
        shared += times[times > 1].sum()
    assert shared < 0.15 * n * tables


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert sign_hash.near_vectors(df).count() == 0


def test_tables_keep_the_miss_bound():
    for n in (10, 10**4, 10**8, 10**11):
        bits, tables = sign_hash.plan(n)
        hit = (1 - np.arccos(0.98) / np.pi) ** bits
        assert (1 - hit) ** tables <= sign_hash.MISS


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_banded_alignment_equals_dynamic_programming():
    rnd = random.Random(4)
    for _ in range(300):
        a = np.array([rnd.randrange(12) for _ in range(rnd.randint(1, 40))], dtype=np.uint64)
        b = np.array([rnd.randrange(12) for _ in range(rnd.randint(1, 40))], dtype=np.uint64)
        assert order_minhash.common_in_band(a, b, 100) == lcs(a.tolist(), b.tolist())
        assert order_minhash.common_in_band(a, b, 3) <= lcs(a.tolist(), b.tolist())


def similarity(a, b):
    common = lcs(a, b)
    return common / (len(a) + len(b) - common)


def grams(text):
    words = order_minhash.words_of(text)
    return [tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def brute_classes(rows):
    """Classes of (id, text): pairs that share shingles are aligned in full."""
    sets = {i: grams(t) for i, t in rows}
    ids = sorted(i for i in sets if sets[i])
    edges = []
    for x, i in enumerate(ids):
        si = set(sets[i])
        for j in ids[x + 1:]:
            if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and si & set(sets[j]) \
                    and similarity(sets[i], sets[j]) >= 0.8 - 1e-12:
                edges.append((i, j))
    return groups(edges, sets)


def test_op8_on_documents_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, SMALL, "documents").collect()]
    want = brute_classes([d for d in docs])
    got = dict(map(tuple, queries.op8_order_minhash(spark, SMALL).collect()))
    assert got == want


def planted_copies(seed, groups_=12, copies=12, length=150):
    """Groups of copies with ever more edits; a common passage in many texts."""
    rnd = random.Random(seed)
    passage = random_words(99, 40)
    rows, k = [], 0
    for g in range(groups_):
        base = random_words(seed * 1000 + g, length)
        if g % 2:
            base = base[:60] + passage + base[60:]
        for c in range(copies):
            words = list(base)
            for _ in range(c // 2):
                at = rnd.randrange(len(words))
                kind = rnd.randrange(3)
                if kind == 0:
                    words[at] = "changed%d" % rnd.randrange(10**6)
                elif kind == 1:
                    del words[at]
                else:
                    words.insert(at, "new%d" % rnd.randrange(10**6))
            rows.append((k, " ".join(words)))
            k += 1
    return rows


def test_near_copies_equal_brute_force(spark, monkeypatch):
    rows = planted_copies(5)
    want = brute_classes(rows)
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows],
                               "doc_id long, text string, lang string, source string, n_chars long")
    assert dict(map(tuple, order_minhash.classes(df).collect())) == want
    monkeypatch.setattr(order_minhash, "BLOCK", 5)
    assert dict(map(tuple, order_minhash.classes(df).collect())) == want
    left = order_minhash.keep_first(df)
    assert left.columns == df.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({c for c in want.values()})


def test_every_pair_of_different_groups_meets_in_one_block(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "BLOCK", 8)
    rnd = random.Random(3)
    rows = [(k, rnd.choice([0] * 6 + list(range(1, 9))) + 100 * b, 0, b) for b, n in enumerate((90, 40, 6, 1)) for k in
            range(1000 * b, 1000 * b + n)]
    rows += [(5000 + k, 7777, 0, 9) for k in range(50)]  # one group: nothing to compare
    keyed = spark.createDataFrame(rows, "rep long, group long, t int, key long")
    buckets = keyed.groupBy("t", "key").count().where("count > 1").withColumnRenamed("count", "size")
    got = order_minhash.group_blocks(keyed, buckets).collect()
    by, meet = {}, {}
    for r in got:
        by.setdefault((r["key"], r["low"], r["high"]), []).append(r)
    for (_, low, high), part in by.items():
        assert len(part) <= 40
        for x in part:
            for y in part:
                if x["rep"] < y["rep"] and x["group"] != y["group"] and (low == high or x["chunk"] != y["chunk"]):
                    meet[x["rep"], y["rep"]] = meet.get((x["rep"], y["rep"]), 0) + 1
    group = {r[0]: (r[1], r[3]) for r in rows}
    assert meet == {(a, b): 1 for a in group for b in group if a < b and group[a][1] == group[b][1] != 9
                    and group[a][0] != group[b][0]}


def test_a_large_tight_group_ships_its_rows_about_once(spark, monkeypatch):
    """Blocks grow with a group of near copies, not with its square."""
    monkeypatch.setattr(order_minhash, "BLOCK", 20)

    def shipped(n):
        keyed = spark.range(n).select(F.col("id").alias("rep"), F.lit(0).alias("t"), F.lit(5).cast("long").alias("key"))
        buckets = keyed.groupBy("t", "key").count().withColumnRenamed("count", "size")
        grouped = keyed.withColumn("group", F.when(F.col("rep") % 50 == 0, F.col("rep")).otherwise(F.lit(1)))
        return order_minhash.seed_blocks(keyed, buckets).count() + order_minhash.group_blocks(grouped, buckets).count()

    assert shipped(800) < 6 * shipped(200) < 6 * 200 * 5


def test_near_copies_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = sorted(((r["doc_id"], r["class_id"]) for r in order_minhash.classes(docs).collect()), key=repr)
    assert got == sorted([(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (5, 5), (6, 5), (None, None), (7, 7), (8, 8)], key=repr)
    left = order_minhash.keep_first(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=repr) == sorted([1, 2, 3, 4, 5, None, 7, 8], key=repr)
    assert order_minhash.classes(no_docs(spark)).count() == 0
    assert order_minhash.keep_first(no_docs(spark)).columns == docs.columns
