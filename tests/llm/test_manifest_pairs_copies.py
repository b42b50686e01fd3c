"""Merkle manifest, cross-tokenizer alignment and exact dedup against DuckDB, the libraries and brute force."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from gleaner.llm import cuckoo_index, merkle_manifest, pair_counts, queries
from tests.compare import assert_same
from tests.llm.common import SMALL, no_docs, odd_docs, random_words, rows_of

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def duck(df=None):
    con = duckdb.connect()
    if df is None:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    else:
        con.register("given", pa.Table.from_batches(df.toArrow().to_batches(), df.toArrow().schema))
        con.execute("CREATE VIEW documents AS SELECT * FROM given")
    return con


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


# Merkle manifest ----------------------------------------------------------------------------


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text), by the definition."""
    import zlib

    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(row, text):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))

    def climb(nodes, tracks):
        """The root, and each track's steps; a track is its place among the nodes."""
        places, steps = list(tracks), [[] for _ in tracks]
        while len(nodes) > 1:
            for i, p in enumerate(places):
                run = p - p % 3
                steps[i].append((nodes[run:p], nodes[p + 1:run + 3]))
                places[i] = p // 3
            nodes = [h(*nodes[k:k + 3]) for k in range(0, len(nodes), 3)]
        return nodes[0], steps

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted(((r[0] is not None, r[0] or 0, leaf(r, r[4])), r) for r in rows if r[1] == s)
        own = [(k[2], r) for k, r in own]
        trees.append((own, *climb([x[0] for x in own], range(len(own)))))
    root, up = climb([t[1] for t in trees], range(len(trees)))
    out = []
    for (own, subroot, steps), above in zip(trees, up):
        for (x, r), path in zip(own, steps):
            path = path + above
            odd = r[0] is None or zlib.crc32(str(r[0]).encode()) % 2
            at = leaf(r, r[4] if odd or r[4] is None else r[4].replace("\n", ""))
            for before, after in path:
                at = h(*before, at, *after)
            out.append((r[0], x, subroot, root, h(*(s for b, a in path for s in b + a)), at, at == root))
    return sorted(out, key=repr)


def test_manifest_of_documents_equals_sql(spark):
    assert_same(queries.op11_merkle_manifest(spark, SMALL), duck(), merkle_manifest.ORACLE)


def test_manifest_of_large_trees_equals_the_definition(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.choice(["big"] * 9 + ["b", None, "é", "zz"]), rnd.choice(["en", None]), rnd.choice([1, 22, None]),
             rnd.choice([None, "", f"line {k}\nline", f"plain {k}"])) for k in rnd.sample(range(10_000), 1100)]
    rows += [(20_000 + k, "big", "en", 1, f"a\n{k}") for k in range(1200)] + [(99_999, "single", None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    got = rows_of(merkle_manifest.manifest(df, merkle_manifest.without_breaks()))
    assert got == plain_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert rows_of(merkle_manifest.manifest(docs, merkle_manifest.without_breaks())) == plain_manifest(rows)
    assert merkle_manifest.manifest(no_docs(spark), merkle_manifest.without_breaks()).count() == 0


def test_manifest_without_tampering_verifies(spark):
    docs = odd_docs(spark)
    assert all(r.verified for r in merkle_manifest.manifest(docs).collect())


def test_nodes_cover_their_intervals(spark):
    rows = documents(spark, [(k, str(k), "en", "s", 1) for k in range(2000)])
    leaves = merkle_manifest.ranked(merkle_manifest.leaves(rows), ["id", "hash"]).cache()
    built = merkle_manifest.build(leaves)
    assert len(built) == 2
    for table in built:
        nodes = table.where("level > 0").collect()
        for level in {n.level for n in nodes}:
            covered = sorted((n.block, n.lo, n.hi) for n in nodes if n.level == level)
            assert all(a[2] == b[1] for a, b in zip(covered, covered[1:]) if a[0] == b[0])
    below = {r["rank"]: r["hash"] for r in leaves.select("rank", "hash").collect()}
    for n in built[0].where("level = 1").collect():
        assert n.hash == hashlib.sha256("".join(below[k] for k in range(n.lo, n.hi)).encode()).hexdigest()


# Cross-tokenizer alignment ---------------------------------------------------------------------


def plain_alignment(rows):
    """The rows of op12 by the definition, from whole texts and the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters, words = pair_counts._byte_letters(), {i: t for t, i in a.get_vocab().items()}
    count, docs = collections.Counter(), []
    for key, text in rows:
        x, y = [], []
        if text:
            x = [(i, bytes(letters[c] for c in words[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
            y = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i)
                  else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
            if not b"".join(t for _, t in x) == b"".join(t for _, t in y) == (" " + text).encode():
                x, y = [], []
        ends = [[*itertools.accumulate(len(t) for _, t in side)] for side in (x, y)]
        links, groups, held, i, k = [], [], ([], []), 0, 0
        while i < len(x):
            links.append((x[i][0], y[k][0]))
            for side, at in zip(held, (i, k)):
                if not side or side[-1] != at:
                    side.append(at)
            p, q = ends[0][i], ends[1][k]
            if p == q:
                groups.append(",".join(str(x[j][0]) for j in held[0]) + "|" + ",".join(str(y[j][0]) for j in held[1]))
                held = ([], [])
            i, k = i + (p <= q), k + (q <= p)
        count.update(links)
        docs.append((key, len(x), len(y), groups, links))
    best = collections.Counter()
    for (_, t), n in count.items():
        best[t] = max(best[t], n)
    return sorted(((key, n, m, len(g), len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if n else "") for key, n, m, g, ls in docs), key=repr)


def test_alignment_of_documents_equals_the_libraries(spark):
    docs = queries.table(spark, SMALL, "documents")
    want = plain_alignment([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert rows_of(queries.op12_pair_counts(spark, SMALL)) == want


def odd_texts(n, seed):
    rnd = random.Random(seed)
    pieces = ["a", " b", "  c", "\n", "\t", " ", "  ", "'s", " don't", "1 ", " 23", "é", " Été", "漢字", " ▁", "▁x", "😀", " x",
              "<|endoftext|>", "<s>", "<unk>", " </s> ", "<0x41>", "\x00", " ", " ", "　", "́", "ﬁ",
              "​", "\r\n", "...", " ,", " Q.", "\u0081", "а", " ж", "﻿", "\x85", " z", " ́a", " aé b"]
    return [(k, "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 14)))) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_alignment_of_odd_texts_through_a_tree(spark, monkeypatch, seed):
    monkeypatch.setattr(pair_counts, "FAN", 2)
    rows = odd_texts(1500, seed) + [(-1, None), (-2, ""), (-3, "x" * 3000), (-4, "same"), (-4, "same"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert rows_of(pair_counts.align(df, A, B)) == plain_alignment(rows)


def test_alignment_of_odd_rows(spark):
    docs = odd_docs(spark)
    want = plain_alignment([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert rows_of(pair_counts.align(docs, A, B)) == want
    assert pair_counts.align(no_docs(spark), A, B).count() == 0


def test_words_cut_anywhere_encode_as_the_whole_text():
    """Every character beside a cut: what stands before it, and after it, leaves the ids as they are."""
    tools = pair_counts.aligner(A, B)
    chars = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    texts = [f"w{c} b{c}x y" for c in chars]
    whole_a = [e.ids for e in tools.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    whole_b = tools.b.encode(texts)
    words, at = tools.cut(pa.array(texts))
    listed = words.to_pylist()
    part_a = [e.ids for e in tools.a.encode_batch(listed, add_special_tokens=False)]
    part_b = tools.b.encode([w[1:] for w in listed])
    for k, (lo, hi) in enumerate(zip(at[:-1], at[1:])):
        assert sum(part_a[lo:hi], []) == whole_a[k] and sum(part_b[lo:hi], []) == whole_b[k], texts[k]


def test_joined_and_fast_encoders_equal_the_files():
    """Words of every kind, many to a text: ids of each as the files' own tokenizers give them one by one."""
    tools, rnd = pair_counts.aligner(A, B), random.Random(12)
    vocabulary = [t for t in tools.a.get_vocab() if t.isascii() and len(t) > 2]

    def word():
        return rnd.choice([
            lambda: "".join(rnd.choice("aab") for _ in range(rnd.randint(1, 30))),
            lambda: "".join(rnd.choice(vocabulary) for _ in range(3)).replace("\u0120", ""),
            lambda: "".join(chr(rnd.randint(33, 126)) for _ in range(rnd.randint(1, 12))),
            lambda: "".join(chr(rnd.choice([rnd.randint(0xC0, 0x24F), rnd.randint(97, 122)])) for _ in range(6)),
            lambda: rnd.choice("abc=-_*# .") * rnd.randint(1, 50), lambda: rnd.choice(["漢字", "▁", "x▁y", "é²½", "\x85\xa0"])])()

    words = [" a" + word() + rnd.choice(["", ",", ".\n", "  ", "\t", "'s", " "]) for _ in range(20_000)]
    a, n_a, b, n_b = tools.ids(pa.array(words, pa.large_string()))
    want_a = [e.ids for e in tools.a.encode_batch(words, add_special_tokens=False)]
    want_b = tools.b.encode([w[1:] for w in words])
    for ids, n, want in ((a, n_a, want_a), (b, n_b, want_b)):
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_perfect_hash_is_minimal_and_verified():
    keys = np.unique(np.random.default_rng(5).integers(0, 1 << 40, 50_000))
    made = pair_counts.PerfectHash.loads(pair_counts.PerfectHash.of(keys).dumps())
    assert sorted(made.index(keys).tolist()) == list(range(len(keys)))
    others = np.setdiff1d(np.random.default_rng(6).integers(0, 1 << 40, 1000), keys)
    held = np.empty_like(keys)
    held[made.index(keys)] = keys
    at = made.index(others)
    assert not ((at >= 0) & (held[at] == others)).any()
    assert len(pair_counts.PerfectHash.of(keys[:0]).index(keys[:3])) == 3


# Exact dedup -------------------------------------------------------------------------------------


def test_dedup_of_documents_equals_sql(spark):
    assert_same(queries.op13_cuckoo_dedup(spark, SMALL), duck(), cuckoo_index.ORACLE)


def test_dedup_of_odd_rows(spark):
    docs = odd_docs(spark)
    assert_same(cuckoo_index.dedup(docs), duck(docs), cuckoo_index.ORACLE)
    assert cuckoo_index.dedup(no_docs(spark)).count() == 0


def test_dedup_with_a_third_of_the_rows_alike(spark, monkeypatch):
    monkeypatch.setattr(cuckoo_index, "HEAVY", 8)  # groups of an eighth or more are broadcast
    rnd = random.Random(8)
    rows = [(k, "hot" if k % 3 == 0 else rnd.choice([None, "", f"t{k % 97}", f"own {k}"]), "en", "s", 1)
            for k in range(6000)]
    docs = documents(spark, rows).repartition(9)
    assert_same(cuckoo_index.dedup(docs), duck(docs), cuckoo_index.ORACLE)


def held_by(index):
    return sorted((r["id"], bytes(r["digest"]).hex()) for r in index.content.collect())


def digest(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_index_after_inserts_and_deletes_equals_a_dictionary(spark):
    rnd = random.Random(11)
    words = random_words(4, 400) + [None, ""]
    rows = [(k, rnd.choice(words)) for k in range(1200)]

    def frame(part):
        return spark.createDataFrame(part, "doc_id long, text string")

    index = cuckoo_index.insert(frame(rows[:300]))
    live = list(rows[:300])
    index = cuckoo_index.insert(frame(rows[300:]), index)
    live += rows[300:]
    assert held_by(index) == sorted((k, digest(t)) for k, t in live)
    gone = rnd.sample(live, 700) + [(5, "never there"), (10**6, words[0])]
    index = cuckoo_index.delete(frame(gone), index)
    live = [r for r in live if r not in set(gone)]
    assert held_by(index) == sorted((k, digest(t)) for k, t in live)
    asked = [(k, w) for k, w in enumerate([*words, "never there", "nor here"])]
    count = collections.Counter(t or "" for _, t in live)
    got = {r["id"]: r["live"] for r in cuckoo_index.lookup(frame(asked), index).collect()}
    assert got == {k: count[w or ""] for k, w in asked}
    # Every live key is in its filter, and the filters hold no more fingerprints than live keys.
    marks = sum(np.count_nonzero(np.frombuffer(r.slots, "<u2")) for r in index.filters.collect())
    assert marks == len({t or "" for _, t in live})


def test_overflow_rebuilds_larger_filters_from_the_stored_keys(spark):
    few = spark.createDataFrame([(k, f"few {k}") for k in range(30)], "doc_id long, text string")
    many = spark.createDataFrame([(k, f"many {k}") for k in range(100, 4100)], "doc_id long, text string")
    index = cuckoo_index.insert(few)
    small = max(len(r.slots) for r in index.filters.collect())
    index = cuckoo_index.insert(many, index)
    assert max(len(r.slots) for r in index.filters.collect()) > small
    assert {r["live"] for r in cuckoo_index.lookup(few.unionByName(many), index).collect()} == {1}
    strange = spark.createDataFrame([(k, f"strange {k}") for k in range(500)], "doc_id long, text string")
    assert {r["live"] for r in cuckoo_index.lookup(strange, index).collect()} == {0}


def test_index_deals_to_more_shards_when_it_outgrows_them(spark, monkeypatch):
    monkeypatch.setattr(cuckoo_index, "SHARD_KEYS", 4)
    monkeypatch.setattr(cuckoo_index, "LEAST_SHARDS", 2)
    first = spark.createDataFrame([(k, f"a {k}") for k in range(8)], "doc_id long, text string")
    more = spark.createDataFrame([(k, f"b {k}") for k in range(8, 80)], "doc_id long, text string")
    index = cuckoo_index.insert(first)
    assert index.shards == 2
    index = cuckoo_index.insert(more, index)
    assert index.shards > 20
    assert {r["live"] for r in cuckoo_index.lookup(first.unionByName(more), index).collect()} == {1}


def test_filter_holds_inserts_until_it_overflows():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 62, 3000).astype(np.uint64))
    own = cuckoo_index.CuckooFilter.sized(len(keys))
    assert own.put(keys) and own.has(keys).all()
    others = np.setdiff1d(rng.integers(0, 1 << 62, 20_000).astype(np.uint64), keys)
    assert own.has(others).mean() < 0.002
    own.drop(keys[:1500])
    assert own.has(keys[1500:]).all() and own.has(keys[:1500]).mean() < 0.01
    assert np.count_nonzero(own.slots) == len(keys) - 1500
    assert not cuckoo_index.CuckooFilter.sized(10).put(keys)
