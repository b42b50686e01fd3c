import random
import re

import duckdb
import pytest

import corpus_pipeline
from gleaner.llm import queries, site_lines, source_mix
from tests.llm.common import LONG, SMALL, no_docs, odd_docs, random_words, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_lines(rows, ratio=site_lines.RATIO, least=site_lines.MIN_PAGES, per_text=False):
    """(doc_id, text) without boilerplate, from (doc_id, source, text) rows; ``per_text`` counts distinct texts."""
    pages, held = {}, {}
    counted = [(0, s, t) for s, t in {r[1:] for r in rows if r[2] is not None}] if per_text else rows
    for _, source, text in counted:
        pages[source] = pages.get(source, 0) + 1
        for key in {x.strip(" \t\r") for x in (text or "").split("\n")} - {""}:
            held[source, key] = held.get((source, key), 0) + 1
    gone = {k for k, n in held.items() if n >= least and n > ratio * pages[k[0]]}
    return sorted(((i, None if text is None else "\n".join(
        x for x in text.split("\n") if (source, x.strip(" \t\r")) not in gone)) for i, source, text in rows), key=repr)


def test_lines_equal_brute_force(spark):
    rnd = random.Random(4)
    common = [" ".join(random_words(k, 4)) for k in range(30)]
    rows = []
    for k in range(200):
        lines = [rnd.choice(common[:3 + 27 * (rnd.random() < 0.3)]) + rnd.choice(["", " ", "\r"])
                 for _ in range(rnd.randint(0, 6))] + [" ".join(random_words(1000 + k, 5))]
        rows.append((k, "\n".join(lines), "en", rnd.choice(["a", "a", "a", "b", None, "few"] if k > 5 else ["few"]), 0))
    df = odd_docs(spark, rows)
    got = site_lines.clean(df)
    assert got.columns == df.columns
    assert rows_of(got.select("doc_id", "text")) == plain_lines([(r[0], r[3], r[1]) for r in rows])


def test_lines_equal_their_oracle(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op1_site_lines(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel = con.sql(site_lines.ORACLE)
    at = [rel.columns.index(c) for c in got.columns]
    assert rows_of(got) == sorted((tuple(r[k] for k in at) for r in rel.fetchall()), key=repr)
    assert got.where("n_dropped > 0").count() > 0


def test_lines_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = site_lines.clean(docs, ratio=0.1, min_pages=2)
    assert got.columns == docs.columns
    texts = rows_of(got.select("doc_id", "text"))
    assert texts == plain_lines([(r["doc_id"], r["source"], r["text"]) for r in docs.collect()], 0.1, 2)
    assert ("5", "") in {(str(a), b) for a, b in texts}  # a text that loses all lines is empty
    assert site_lines.clean(no_docs(spark)).count() == 0


@pytest.mark.parametrize("copies", [17, 400])
def test_op1_keeps_the_lines_of_a_copied_document(spark, tmp_path, copies):
    """A document copied to a third of a host and more keeps its lines; a line on many distinct texts goes."""
    copied = "\n".join(" ".join(random_words(k, 8)) for k in range(6))
    rows = [(k, copied, "en", "a", 0) for k in range(copies)]
    rows += [(1000 + k, " ".join(random_words(100 + k, 9)) + "\nAll pages", "en", "a", 0) for k in range(34)]
    odd_docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["text"] for r in queries.op1_site_lines(spark, str(tmp_path)).collect()}
    for k, text, *_ in rows:
        assert got[k] == text.removesuffix("\nAll pages"), k


def test_texts_are_not_shuffled_to_meet_the_boilerplate(spark):
    plan = queries.op1_site_lines(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_pipeline_keeps_the_lines_of_a_copied_document(spark):
    copied = "\n".join(" ".join(random_words(k, 8)) for k in range(6))
    rows = [(k, copied if k % 3 == 0 else " ".join(random_words(100 + k, 9)) + ("\nAll pages" if k % 3 == 1 else ""),
             "en", "a", 0) for k in range(90)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_boilerplate(spark, odd_docs(spark, rows), SMALL).collect()}
    for k, text, *_ in rows:
        assert got[k] == text.removesuffix("\nAll pages"), k


def test_pipeline_drops_lines_of_a_few_percent_of_a_large_source(spark):
    rows = [(k, f"{' '.join(random_words(k, 9))}\n" + ("Share this page" if k % 33 == 0 else "Said on few pages" if k < 8
             else f"line {k}"), "en", "a", 0) for k in range(500)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_boilerplate(spark, odd_docs(spark, rows), SMALL).collect()}
    for k, text, *_ in rows:
        lines = text.split("\n")
        assert got[k].split("\n") == (lines[:1] if k % 33 == 0 else lines), k


def plain_targets(sizes):
    """Targets of {source: size} by the contract's words: share by weight, cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / free for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def highest_quotients(votes, seats):
    """Sainte-Laguë seat by seat; equal quotients go to the first."""
    won = [0] * len(votes)
    for _ in range(seats):
        k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[k] += 1
    return won


def test_seats_equal_highest_quotients(spark):
    rnd = random.Random(9)
    rows, want = [], {}
    for g in range(25):
        votes = [rnd.choice([rnd.randrange(1, 50), rnd.randrange(1, 10**6), 7, 0]) for _ in range(rnd.randint(1, 15))]
        votes[0] = max(votes[0], 1)
        seats = rnd.choice([0, 1, 2, 5, 17, 200])
        rows += [(g, k, v, seats) for k, v in enumerate(votes)]
        want.update({(g, k): w for k, w in enumerate(highest_quotients(votes, seats))})
    df = spark.createDataFrame(rows, "g int, k int, votes long, seats long")
    from pyspark.sql import functions as F

    got = source_mix.sainte_lague(df, ["g"], "votes", "seats", [F.col("k")]).collect()
    assert {(r["g"], r["k"]): r["won"] for r in got} == want


def check_mix(rows, docs):
    sizes = {}
    for r in docs:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(WORD.findall(r["text"] or ""))
    target = plain_targets(sizes)
    by = {}
    assert len(rows) == len(docs)
    source = {r["doc_id"]: r["source"] for r in docs}
    text = {r["doc_id"]: r["text"] for r in docs}
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == len(WORD.findall(text[r["doc_id"]] or ""))
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[s] = by.get(s, 0) + r["taken"]
    for s, got in by.items():
        assert abs(got - target[s]) <= 2 * source_mix.BLOCK, (s, got, target[s])


def test_op6_on_documents(spark):
    docs = queries.table(spark, SMALL, "documents").select("doc_id", "source", "text").collect()
    rows = queries.op6_source_mix(spark, SMALL).collect()
    check_mix(rows, docs)
    assert rows_of(queries.op6_source_mix(spark, SMALL)) == sorted(map(tuple, rows), key=repr)


def test_mix_with_caps_and_many_shards(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "SHARD_WORDS", 500)
    rnd = random.Random(1)
    rows = [(k, " ".join(["w"] * rnd.randrange(0, 60)), "en", rnd.choice(["a"] * 30 + ["b", "c", "d", None]), 0)
            for k in range(700)]
    df = odd_docs(spark, rows)
    mixed = source_mix.mix(df)
    got = mixed.collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    target, by = plain_targets(sizes), {}
    for r in got:
        by[rows[r["doc_id"]][3]] = by.get(rows[r["doc_id"]][3], 0) + r["taken"]
        assert r["taken"] <= 3 * r["size"]
    assert any(target[s] == 3 * sizes[s] for s in sizes)
    for s in sizes:
        assert abs(by[s] - target[s]) <= 2 * source_mix.BLOCK


def test_mixed_rows_are_whole_documents_near_what_is_taken(spark):
    docs = queries.table(spark, SMALL, "documents")
    mixed = source_mix.mixed_rows(docs)
    assert mixed.columns == docs.columns
    times = {}
    rows = {r["doc_id"]: r for r in docs.collect()}
    for r in mixed.collect():
        assert r == rows[r["doc_id"]]
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    seams = {}
    for r in source_mix.mix(docs).collect():
        n = times.get(r["doc_id"], 0)
        assert n <= 3 and abs(n * r["size"] - r["taken"]) <= r["size"] / 2
        if n * r["size"] != r["taken"]:
            seams[rows[r["doc_id"]]["source"]] = seams.get(rows[r["doc_id"]]["source"], 0) + 1
    assert seams and max(seams.values()) == 1  # a source of this table is one shard


def test_mix_of_odd_rows(spark):
    docs = odd_docs(spark)
    rows = source_mix.mix(docs).collect()
    assert len(rows) == 10
    assert {r["taken"] for r in rows if r["doc_id"] in (2, 3, 7)} == {0}
    sizes = {}
    for r in docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(WORD.findall(r["text"] or ""))
    target = plain_targets(sizes)
    assert [r["target"] for r in rows if r["doc_id"] == 4] == [pytest.approx(target[None])]
    assert sizes[None] == len(LONG.split())
    assert source_mix.mixed_rows(docs).columns == docs.columns
    assert source_mix.mix(no_docs(spark)).count() == 0
    assert source_mix.mixed_rows(no_docs(spark)).count() == 0
    blank = odd_docs(spark, [(1, None, "en", "a", 0), (2, "", "en", "b", 0)])
    assert {r["taken"] for r in source_mix.mix(blank).collect()} == {0}


def test_pipeline_equals_its_stages_by_brute_force(spark):
    """run() against decisions computed without the operators' Spark plans."""
    import public_tokenizers
    import sentencepiece

    from gleaner.llm import site_quality
    from tests.llm.test_vectors_near import brute_classes

    docs = queries.table(spark, SMALL, "documents")
    kept = {r["doc_id"] for r in site_quality.classify(docs, queries.table(spark, SMALL, "labels")).where("kept").collect()}
    rows = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] in kept}
    text = dict(plain_lines([(k, r["source"], r["text"]) for k, r in rows.items()], site_lines.TEXT_RATIO, per_text=True))
    firsts = set(brute_classes(list(text.items())).values())
    sizes = {}
    for k in firsts:
        sizes[rows[k]["source"]] = sizes.get(rows[k]["source"], 0) + len(WORD.findall(text[k] or ""))
    target = plain_targets(sizes)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    by = {}
    for r in corpus_pipeline.run(spark, SMALL).collect():
        assert r["doc_id"] in firsts
        assert list(r["ids"]) == sp.encode(text[r["doc_id"]]) and r["decoded"] == text[r["doc_id"]]  # whole texts
        source = rows[r["doc_id"]]["source"]
        by[source] = by.get(source, 0) + len(WORD.findall(r["decoded"]))
    longest = {}
    for k in firsts:
        longest[rows[k]["source"]] = max(longest.get(rows[k]["source"], 0), len(WORD.findall(text[k] or "")))
    for source, t in target.items():  # a source of this table is one shard, with one seam
        assert abs(by.get(source, 0) - t) <= 2 * source_mix.BLOCK + longest[source] / 2


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    docs = odd_docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns, name
        assert stage(spark, no_docs(spark), SMALL).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()
