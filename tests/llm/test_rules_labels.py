import random
import re
import zlib

import numpy as np
import pytest

from gleaner.llm import isolation_rules, licenses, queries, site_quality, text_stats, toxic_terms
from tests.llm.common import LONG, SMALL, labels, no_docs, odd_docs, random_words, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_stats(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) by the definitions."""
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    where = {}
    for k in range(len(words) - 4):
        where.setdefault(tuple(words[k:k + 5]), []).append(k)
    covered = {k + j for at in where.values() if len(at) > 1 for k in at for j in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def random_texts(seed, n):
    rnd = random.Random(seed)
    words = random_words(seed, 12) + ["é", "漢字", "a|b", "###", "\x1c", "\xa0", " "]
    return ["".join(rnd.choice(words) + rnd.choice([" ", " ", "\n", "\t", "\r\n", "\x0b", "  "])
                    for _ in range(rnd.randint(0, 80))) for _ in range(n)] + ["", "\n\n", " x", "x"]


def test_stats_equal_their_definitions():
    import pyarrow as pa

    texts = random_texts(1, 400) + [None]
    got = text_stats.stats_of(pa.array(texts))
    assert [tuple(r[:5]) for r in got.tolist()] == [plain_stats(t) for t in texts]


def test_windows_beyond_one_number_are_exact():
    words = [str(k).encode() for k in range(9000)] + [b"x"] * 3 + [str(k).encode() for k in range(7)]
    text = b" ".join(words).decode()
    assert text_stats.repeated_windows(words)[0] == plain_stats(text)[4] > 0


def test_op4_on_documents(spark):
    rows = {r["doc_id"]: r for r in queries.op4_isolation_rules(spark, SMALL).collect()}
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, SMALL, "documents").collect()}
    assert rows.keys() == docs.keys()
    for k, text in docs.items():
        r, want = rows[k], plain_stats(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_verdicts_on_labels_not_fitted(spark):
    sf = "/root/testdata/sf0.01"
    docs, marks = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    rules = isolation_rules.fit(docs, marks.where("doc_id % 2 = 0"))
    rows = isolation_rules.apply(docs, rules).join(marks.where("doc_id % 2 = 1"), "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.1


def test_rules_without_labels_and_odd_rows(spark):
    docs = odd_docs(spark)
    rules = isolation_rules.fit(docs, labels(spark))
    assert rules.forest is None
    rows = isolation_rules.apply(docs, rules).collect()
    assert len(rows) == 10 and all(r["kept"] == (not r["base_failed"]) for r in rows)
    assert {r["n_words"] for r in rows if r["doc_id"] in (2, 3, 7)} == {0}
    assert next(r for r in rows if r["doc_id"] == 4)["n_words"] == len(LONG.split())
    assert isolation_rules.apply(no_docs(spark), rules).count() == 0
    assert isolation_rules.fit(no_docs(spark), labels(spark, [(1, 1, 0)])).forest is None


def many_labelled(spark):
    """More labelled documents than the 8,000 that models once were fitted on, as rows, tables and in memory."""
    import pyarrow as pa

    rows = [(k, " ".join([f"word{j}" for j in range(12 + k % 40)] + [f"w{k % 7}", "#" * (k % 5), "A" * (k % 11)]), None, None, 1) for k in range(9000)]
    marks = [(r[0], int(r[0] % 13 > 1), None) for r in rows]
    stats = text_stats.stats_of(pa.array([r[1] for r in rows]))
    return odd_docs(spark, rows).repartition(4), labels(spark, marks), stats, np.array([m[1] for m in marks])


def test_rules_are_fitted_on_all_labelled_rows(spark):
    docs, marks, stats, y = many_labelled(spark)
    rules = isolation_rules.fit(docs, marks)
    passed = ~isolation_rules.base_failed(stats)
    x, good = isolation_rules.features(stats[passed]), y[passed] == 1
    want = isolation_rules.Forest.fit(x[good], x.min(axis=0), x.max(axis=0))
    assert (rules.forest.feature == want.feature).all() and np.allclose(rules.forest.path, want.path)
    cells = np.ceil(want.score(x) * isolation_rules.SCORE_CELLS) / isolation_rules.SCORE_CELLS
    assert rules.threshold == isolation_rules.calibrate(cells, good)
    once = isolation_rules.verdicts(docs, marks)
    assert rows_of(once) == rows_of(isolation_rules.apply(docs, rules))


def test_evidence_is_fitted_on_all_labelled_rows(spark):
    docs, marks, stats, y = many_labelled(spark)
    got = site_quality.fit(text_stats.stored_stats(docs, {"id": "doc_id"}), marks)
    want = site_quality.Evidence.fit(site_quality.features(stats), y)
    assert got.base == y.mean() and np.allclose(got.weights, want.weights) and np.allclose(got.scale, want.scale)


def test_threshold_keeps_the_good():
    rng = np.random.default_rng(1)
    score = np.concatenate([rng.normal(0.4, 0.02, 1000), rng.normal(0.7, 0.02, 100)])
    good = np.arange(1100) < 1000
    cut = isolation_rules.calibrate(score, good)
    assert (score[good] <= cut).mean() >= 0.995 and (score[~good] <= cut).mean() == 0
    assert isolation_rules.calibrate(score, np.ones(1100, dtype=bool)) == float("inf")


# quality classifier ---------------------------------------------------------------------


def plain_bayes(rows, model_base):
    """Scores of (host, path, logit) rows, computed from the formulas one row at a time."""
    p = [1 / (1 + np.exp(-r[2])) for r in rows]
    sites, hosts = {}, {}
    for r, x in zip(rows, p):
        for table, key in ((sites, r[:2]), (hosts, r[0])):
            n, g = table.get(key, (0, 0.0))
            table[key] = (n + 1, g + x)
    prior = sum(p) / len(p)

    def strength(groups):
        n = np.array([g[0] for g in groups], float)
        rate, to = np.array([g[1] / g[0] for g in groups]), np.array([g[2] for g in groups])
        chance = to * (1 - to)
        between = ((n * (rate - to) ** 2).sum() - chance.sum()) / max(1e-9, n.sum() - (n * n).sum() / n.sum())
        return min(1e6, max(1.0, chance.mean() / between - 1)) if between > 0 else 1e6

    kh = strength([(n, g, prior) for n, g in hosts.values()])
    host_rate = {h: (g + kh * prior) / (n + kh) for h, (n, g) in hosts.items()}
    kp = strength([(n, g, host_rate[s[0]]) for s, (n, g) in sites.items()])
    out = []
    for r, x in zip(rows, p):
        n, g = sites[r[:2]]
        rate = (g - x + kp * host_rate[r[0]]) / (n - 1 + kp)
        rate = min(1 - 1e-6, max(1e-6, rate))
        logit = r[2] - np.log(model_base / (1 - model_base)) + np.log(rate / (1 - rate))
        out.append((host_rate[r[0]], 1 / (1 + np.exp(-logit))))
    return out


def test_site_posteriors_equal_their_formulas(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice(["a", "a", "a", "b", "c", None]), rnd.choice(["x", "y", None]), rnd.gauss(0, 3))
            for _ in range(300)] + [("lone", "z", -2.0)]
    df = spark.createDataFrame(rows, "h string, p string, logit double")
    rates = site_quality.site_rates(df.selectExpr("*", "1 / (1 + exp(-logit)) AS prob"), "h", "p", "prob")
    got = site_quality.combine(df, rates, "h", "p", "logit", 0.8).collect()
    want = {r: w for r, w in zip(rows, plain_bayes(rows, 0.8))}
    assert len(got) == len(rows)
    for r in got:
        host_rate, score = want[(r["h"], r["p"], r["logit"])]
        assert r["host_rate"] == pytest.approx(host_rate) and r["score"] == pytest.approx(score)
        assert r["kept"] == (r["score"] >= 0.5)


def test_sparse_sites_shrink_toward_the_prior(spark):
    rows = [("big", "x", -3.0)] * 500 + [("good", "x", 3.0)] * 500 + [("sparse", "x", -3.0)]
    df = spark.createDataFrame(rows, "h string, p string, logit double").selectExpr("*", "1 / (1 + exp(-logit)) AS prob")
    rates = {r["host"]: r["host_rate"] for r in site_quality.site_rates(df, "h", "p", "prob").collect()}
    assert rates["big"] < 0.1 and rates["good"] > 0.9 and rates["big"] < rates["sparse"] < 0.5


def test_quality_on_labels_not_fitted(spark):
    sf = "/root/testdata/sf0.01"
    docs, marks = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    rows = site_quality.classify(docs, marks.where("doc_id % 2 = 0")).join(marks.where("doc_id % 2 = 1"), "doc_id").collect()
    assert np.mean([r["kept"] for r in rows if r["quality"] == 1]) >= 0.98
    assert np.mean([r["kept"] for r in rows if r["quality"] == 0]) <= 0.05


def test_quality_of_odd_rows(spark):
    docs = odd_docs(spark)
    assert site_quality.classify(docs, labels(spark)).where("kept").count() == 10
    left = site_quality.keep_good(docs, labels(spark))
    assert left.columns == docs.columns and rows_of(left) == rows_of(docs)
    marks = labels(spark, [(1, 1, 0), (5, 1, 0), (3, 0, 0), (7, 0, 0), (6, None, 1)])
    assert site_quality.classify(docs, marks).count() == 10
    assert site_quality.keep_good(docs, marks).columns == docs.columns
    assert site_quality.classify(no_docs(spark), marks).count() == 0
    assert site_quality.keep_good(no_docs(spark), marks).columns == docs.columns


def plain_path(forest, tree, row):
    """Path length of a row in a tree, by walking it: splits passed, and what a leaf of so many rows adds."""
    node, steps = 0, 0
    while forest.feature[tree, node] >= 0:
        above = row[forest.feature[tree, node]] > forest.threshold[tree, node]
        node = forest.child[tree, node] + above
        steps += 1
    return steps, forest.path[tree, node]


def test_forest_equals_walked_paths():
    rng = np.random.default_rng(3)
    rows = rng.random((400, 7)) ** 2
    forest = isolation_rules.Forest.fit(rows, rows.min(axis=0), rows.max(axis=0), trees=30)
    usual = 2 * (np.log(forest.subsample - 1) + np.euler_gamma) - 2 * (forest.subsample - 1) / forest.subsample
    probes = np.vstack([rows[:40], rng.random((20, 7)), np.ones((1, 7))])
    for row, score in zip(probes, forest.score(probes)):
        walked = [plain_path(forest, t, row) for t in range(30)]
        assert all(steps <= path for steps, path in walked)
        assert score == pytest.approx(2 ** (-np.mean([path for _, path in walked]) / usual))
    assert forest.score(np.ones((1, 7)))[0] > np.median(forest.score(rows))


def test_words_of_strange_length_raise_the_anomaly():
    plain, wide = ([300, 300 * size, 0, 0, 0, 9, 1200, 0, 40, 0, 9, 200] for size in (5, 60))
    rng = np.random.default_rng(2)
    rows = np.array([[n, n * w, 0, 0, 0, n // 30, n * w, 0, n // 8, 0, 9, n // 2] for n, w in
                     zip(rng.integers(20, 900, 300), rng.integers(4, 7, 300))] + [wide])
    x = isolation_rules.features(rows)
    forest = isolation_rules.Forest.fit(x[:-1], x.min(axis=0), x.max(axis=0))
    score = forest.score(isolation_rules.features(np.array([plain, wide])))
    assert score[1] > score[0] + 0.1


# toxicity -------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_automata_find_every_near_term():
    terms = sorted(set(random_words(3, 150, "abcde", 9)) | set(random_words(4, 50, "abcdefgh", 14)) | {"abcde" * 8, "a" * 33})
    trie, lexicon = toxic_terms.Trie(terms), toxic_terms.Lexicon(terms)
    for word in random_words(5, 300, "abcde", 13) + ["abcde" * 7 + "abce", "a" * 31, "a" * 35, "a" * 36, "b" * 90]:
        want = sorted((t, distance(word, t)) for t in terms if distance(word, t) <= toxic_terms.allowed(t))
        assert sorted(trie.near(word)) == want
        # The index may leave out a term that allows no edit, which is only looked up exactly.
        assert sorted(lexicon.near(word)) == [x for x in want if toxic_terms.allowed(x[0])]
        assert not lexicon.near(word) or lexicon.may_meet([word]) == [word]


def test_hashes_of_deletions_equal_those_of_the_words():
    for word in ("a", "ab", "scum", "idiot", "disgusting", "été漢😀x"):
        for k in (0, 1, 2):
            got = set(toxic_terms.deletion_hashes([word, word[::-1]], k)[0].tolist())
            rests = [w for w in toxic_terms.deletions(word, k) if w] if len(word) > k else [word]
            want = {int(toxic_terms.deletion_hashes([w], 0)[0, 0]) for w in rests}
            assert want <= got and len(got) == len(want) or len(word) <= k


def test_most_words_meet_no_term():
    lexicon = toxic_terms.Lexicon(random_words(1, 300, longest=14))
    words = list(set(random_words(2, 5000, longest=14)))
    met = set(lexicon.may_meet(words))
    near = {w for w in words if lexicon.near(w)}
    assert near <= met and len(met - near) < 0.2 * len(words)


def test_edits_go_by_the_length_of_the_term():
    weights = dict.fromkeys(["idiot", "scum", "trash", "disgusting", "ass"], 1.0)
    lexicon = toxic_terms.Lexicon(weights)
    for form, term in {"idot": "idiot", "idioot": "idiot", "scm": "scum", "scvm": "scum", "trsh": "trash",
                       "digustng": "disgusting", "ass": "ass", "disgusting": "disgusting"}.items():
        assert lexicon.closest(form, weights)[0] == term
    assert [lexicon.closest(w, weights) for w in ("as", "idt", "sm", "digstng", "1234")] == [None] * 5


def at_word(text, word):
    spans = [m.span() for m in toxic_terms.WORD.finditer(text)]
    return toxic_terms.context(text, spans, [text[a:b] for a, b in spans].index(word))


def test_context_tells_quotation_from_abuse():
    assert at_word('he said "you idiot" and left', "idiot")[0] > 0.5
    assert at_word("you are an idiot today", "idiot") == (0.0, 1)


def test_context_is_six_words_whatever_their_length():
    long = " ".join(["extraordinarily" * 3] * 5)
    assert at_word(f"she said {long} idiot", "idiot")[0] == 0.4
    assert at_word(f"she said {long} more idiot", "idiot")[0] == 0.0
    assert at_word(f"idiot {long} said", "idiot")[0] == 0.4
    assert at_word(f'x "{long} idiot {long}" y', "idiot")[0] == 0.8


def toxic_docs(n=400):
    rnd = random.Random(6)
    rows, marks = [], []
    for k in range(n):
        words = random_words(k, 40, "abcdefghij")
        toxic = k % 4 == 0
        if toxic:
            words[rnd.randrange(40)] = rnd.choice(["wretchling", "scoundrel", "nincompoop"])
        rows.append((k, " ".join(words), "en", "a", 0))
        marks.append((k, 1, int(toxic)))
    return rows, marks


def test_toxic_terms_are_learned_and_their_misspellings_found(spark):
    rows, marks = toxic_docs()
    tests = [(10_000, "what a scoundrel he is", 1), (10_001, "what a scoundrl he is", 1), (10_002, "a nincompop", 1),
             (10_003, "nothing of that kind", 0), (10_004, "", 0), (10_005, None, 0)]
    docs = odd_docs(spark, rows + [(k, t, "en", "b", 0) for k, t, _ in tests])
    model = toxic_terms.fit(docs, labels(spark, marks))
    assert set(model.weights) == {"wretchling", "scoundrel", "nincompoop"}
    got = {r["doc_id"]: r for r in toxic_terms.score(docs, model).collect()}
    assert [got[k]["predicted"] for k, _, _ in tests] == [y for _, _, y in tests]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    held = [(r["predicted"], dict((m[0], m[2]) for m in marks)[k]) for k, r in got.items() if k < 400 and r["held_out"]]
    assert np.mean([a == b for a, b in held]) >= 0.95


def test_copies_of_a_toxic_text_are_no_evidence(spark):
    """A third of all labelled rows are copies of one toxic text: terms and weights stay."""
    rows, marks = toxic_docs()
    copies = [(20_000 + k, rows[0][1], "en", "a", 0) for k in range(200)]
    plain = toxic_terms.fit(odd_docs(spark, rows), labels(spark, marks))
    skewed = toxic_terms.fit(odd_docs(spark, rows + copies), labels(spark, marks + [(r[0], 1, 1) for r in copies]))
    assert set(plain.weights) == set(skewed.weights) and len(plain.weights) == 3


def test_lexicon_equals_brute_force(spark):
    rows, marks = toxic_docs()
    texts = {k: t for k, t, *_ in rows}
    train = {(texts[k], y) for k, _, y in marks if zlib.crc32(str(k).encode()) % 5}
    toxic, clean = (sum(y == v for _, y in train) for v in (1, 0))
    count = {}
    for text, y in train:
        for w in set(re.findall(r"\w+", text.lower())):
            count.setdefault(w, [0, 0])[1 - y] += 1
    least, rate = 2 * np.log(len(count)) + 4, toxic / (toxic + clean)
    want = {}
    for w, (a, b) in count.items():
        g2 = 2 * ((a * np.log(a / ((a + b) * rate)) if a else 0) + (b * np.log(b / ((a + b) * (1 - rate))) if b else 0))
        if a >= 3 and a >= 0.75 * (a + b) and g2 >= least:
            want[w] = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1))
    got = toxic_terms.fit(odd_docs(spark, rows), labels(spark, marks)).weights
    assert set(got) == set(want) and all(abs(got[w] - want[w]) < 1e-9 for w in got)


def test_ordinary_words_near_a_term_are_no_hits(spark):
    rows, marks = toxic_docs()
    rows = [(k, t + (" scoundrels" if k % 4 in (1, 2) and k < 100 else ""), *rest) for k, t, *rest in rows]
    model = toxic_terms.fit(odd_docs(spark, rows), labels(spark, marks))
    assert "scoundrels" in model.ordinary and "scoundrel" in model.weights
    ordinary, misspelt = model.features(["all scoundrels", "a scoundrl"])
    assert ordinary == [0.0] * 7 != misspelt


def test_held_out_labels_are_never_read(spark):
    rows, marks = toxic_docs()
    docs = odd_docs(spark, rows)
    flipped = [(k, q, 1 - y if zlib.crc32(str(k).encode()) % 5 == 0 else y) for k, q, y in marks]
    a = toxic_terms.score(docs, toxic_terms.fit(docs, labels(spark, marks)))
    b = toxic_terms.score(docs, toxic_terms.fit(docs, labels(spark, flipped)))
    assert rows_of(a) == rows_of(b)


def test_toxicity_of_odd_rows(spark):
    docs = odd_docs(spark)
    model = toxic_terms.fit(docs, labels(spark))
    assert {r["score"] for r in toxic_terms.score(docs, model).collect()} == {0.0}
    assert toxic_terms.score(no_docs(spark), model).count() == 0
    assert toxic_terms.fit(no_docs(spark), labels(spark, [(1, 1, 1)])).weights == {}


# licenses -------------------------------------------------------------------------------

LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_edits(pattern, text):
    """Fewest edits of ``pattern`` against any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        last, row[0] = row[0], i + 1
        for j, d in enumerate(text):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (c != d))
    return min(row)


def messed(rnd, text):
    for _ in range(rnd.randint(0, 9)):
        at, kind = rnd.randrange(len(text)), rnd.random()
        text = text[:at] + ("" if kind < 0.4 else rnd.choice("abel ") + text[at] * (kind < 0.7)) + text[at + 1:]
    return text


def test_least_edits_equal_the_table():
    rnd = random.Random(4)
    for _ in range(400):
        notice = rnd.choice(list(licenses.NOTICES))
        text = "foo " * rnd.randint(0, 2) + messed(rnd, notice) + " bar" * rnd.randint(0, 2)
        assert licenses.least_edits(licenses.letter_masks(notice.encode()), len(notice), text.encode()) == plain_edits(
            notice, text)


def test_notices_are_found_wherever_their_edits_allow():
    """Every notice within its edits of some part of a text gives its label, and no other does."""
    rnd = random.Random(9)
    for _ in range(300):
        notice = rnd.choice(list(licenses.NOTICES))
        text = " ".join(messed(rnd, "some words before " + notice + " and after it").split())
        normal = f" {text} ".encode()
        got = {x[0] for x in licenses.fuzzy(normal, licenses.Blanks(normal))}
        near = {n: plain_edits(n, normal.decode()) <= max(1, len(n) * licenses.EDITS_PER_100 // 100) for n in licenses.NOTICES}
        assert got == {licenses.NOTICES[n] for n, is_near in near.items() if is_near}


def test_a_megabyte_of_notices_takes_seconds():
    import time

    for part, n in (("licensed under the apache license version 2 0 ", 24_000), ("mit licence ", 85_000),
                    ("under the terms of the gnu lesser general public licence ", 17_500)):
        began = time.time()
        _, _, notices = licenses.scan_text(part * n)
        assert len(notices) >= n and time.time() - began < 10


def plain_base(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = LICENSE_WORD.findall(lower)
    found = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found += [(label, k) for k in range(len(words) - len(p) + 1) if words[k:k + len(p)] == p]
    return len(words), sorted(found)


def test_phrases_equal_their_definition():
    rnd = random.Random(2)
    parts = ["GNU", "general", "Public", "license", "apache", "MIT", "cc", "by", "BY", "é", "x", "0"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) + rnd.choice([" ", "-", ".\n", "", "  "]) for _ in range(rnd.randint(0, 25)))
        n, base, _ = licenses.scan_text(text)
        assert (n, base) == plain_base(text)


def test_notices_with_edits_are_found_with_their_span():
    rnd = random.Random(3)
    for notice, label in licenses.NOTICES.items():
        edits = max(1, len(notice) * licenses.EDITS_PER_100 // 100)
        for _ in range(30):
            chars = list(notice)
            for _ in range(rnd.randint(0, edits)):
                at = rnd.randrange(1, len(chars) - 1)
                if chars[at] == " ":
                    continue
                kind = rnd.randrange(3)
                if kind == 0:
                    chars[at] = rnd.choice("abcxyz")
                elif kind == 1:
                    chars.insert(at, rnd.choice("abcxyz"))
                elif chars[at - 1] != " " or chars[at + 1] != " ":
                    del chars[at]
            text = "lead words here. " + "".join(chars) + ", tail words"
            spans = [s for s in licenses.scan_text(text)[2] if s[0] == label]
            assert spans, (notice, text)
            assert any(abs(s[1] - 3) <= 1 and s[3] <= edits for s in spans)


def test_clean_text_has_no_notice():
    text = " ".join(random_words(9, 5000)) + " the license of a public work is a general matter of permission"
    assert licenses.scan_text(text)[1:] == ([], [])


def test_misspelled_phrases_are_notices():
    for text, span in (("The MIT Licence", ("mit", 1, 2, 1)), ("see Apache Licence 2.0", ("apache", 1, 2, 1)),
                       ("licensed under the Apache Licence 2.0", ("apache", 3, 4, 1)),
                       ("Apche License", ("apache", 0, 1, 1)), ("GNU Genral Public Licence v3", ("gpl", 0, 3, 2)),
                       ("Apache License, not Apache Licence", ("apache", 3, 4, 1))):
        assert span in licenses.scan_text(text)[2], text
        assert licenses.scan_text(text)[1] == plain_base(text)[1]
    for text in ("it license", "permit license", "submit licence", "MIT License", "Apache License", "a licence",
                 "GNU General Public License", "the general public license", "cc bye", "mit " * 50):
        assert licenses.scan_text(text)[2] == [], text


def test_op10_on_documents(spark):
    rows = queries.op10_licenses(spark, SMALL).collect()
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, SMALL, "documents").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        n, base = plain_base(docs[r["doc_id"]])
        at = [k for _, k in base]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (
            n, len(base), min(at, default=None), max(at, default=None))
        names = {x for x, _ in base}
        assert r["base_labels"] == ",".join(sorted(names)) and names <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


def test_licenses_of_odd_rows(spark):
    rows = licenses.summary(licenses.scan(odd_docs(spark))).collect()
    assert len(rows) == 10
    assert all((r["n_words"], r["n_base"], r["first_word"], r["labels"], r["score"]) == (0, 0, None, "", 0.0)
               for r in rows if r["doc_id"] in (2, 3, 7))
    assert licenses.summary(licenses.scan(no_docs(spark))).count() == 0
