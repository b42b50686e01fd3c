"""Toxicity by a learned lexicon: Levenshtein automata meet the lexicon's trie, context windows weigh each hit.

**Sample.** The model learns from at most ``MAX_LABELLED`` labelled rows that are not
held out, chosen by a hash of their ids; equal texts count once. They are written
once, and everything learned comes from them.

**Lexicon.** Words that toxic texts of the sample hold far more often than the
others: log-likelihood ratio above a bound that grows with the number of distinct
words, and at least ``PRECISION`` of their texts toxic. A term stands in three
texts of the sample or more, which bounds the lexicon; nothing else does.

**Misspelled terms.** The terms form a trie. For a word of a text, the states of
its Levenshtein automaton (the row of edit distances to each of its prefixes)
are carried along the trie's edges; branches where every state is beyond the
bound are left. How many edits a term may have goes by its own length. Words
within so many edits of a term share with it a word that both give by as many
deletions, so an index of the terms' deletions tells which part of the trie can
meet a word at all. Most words meet none: hashes of all deletions of the distinct
words of a slice of texts are looked up at once, in flat arrays, and only words
with a hit go on to the trie. Words near a term that clean texts of the sample use are ordinary
words, not misspellings; how far the other forms of a term can be trusted is
learned as well.

**Context.** Around each hit a window of ``SPAN`` words to each side is scored:
quotation marks and reporting words speak for quotation, second-person words
for abuse. Hits count by their weight times the window's score.

**Score.** A logistic regression on the hits' features, fitted on the sample.
Scores need no shuffle.

Defined cases: NULL and empty texts have no hits and get the score of that;
without training rows of both classes the lexicon is empty and every score 0;
repeated rows get equal scores; an empty table gives an empty result; only the
id and text columns are read, so other columns cannot clash. Texts are read
whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.flat import slices
from gleaner.llm.lineage import cut
from gleaner.llm.site_quality import Evidence

MAX_LABELLED = 50_000
PRECISION = 0.75
#: Letters of a term from which one edit and two are allowed.
ONE_EDIT_FROM, TWO_EDITS_FROM = 4, 10
#: Terms so long that their deletions would fill the index: always part of the trie that is walked.
LONG_TERM = 32
SPAN = 6
#: Share of a term's weight that its misspelled forms have if the sample holds none at all.
UNSEEN_TRUST = 0.8

WORD = re.compile(r"\w+")

# Words that report what others say, words that address someone, quotation marks.
REPORTING = {"said", "says", "say", "wrote", "writes", "quote", "quoted", "quotes", "called", "term", "word",
             "dit", "sagte", "dijo"}
ADDRESSING = {"you", "your", "you're", "u", "ur", "du", "dein", "tu", "vous", "usted"}
QUOTES = set("\"“”„«»‘’")


def allowed(term: str) -> int:
    """Edits that a misspelled form of a term may have."""
    return (len(term) >= ONE_EDIT_FROM) + (len(term) >= TWO_EDITS_FROM)


def deletions(word: str, k: int) -> set[str]:
    """What is left of a word once up to ``k`` letters are taken out."""
    out = {word}
    for _ in range(k):
        out |= {w[:i] + w[i + 1:] for w in out for i in range(len(w))}
    return out


class Trie:
    """Terms as a trie; a node is (children by letter, terms ending here, most edits of the terms below)."""

    def __init__(self, terms):
        self.root = self._node()
        for term in terms:
            k, node = allowed(term), self.root
            node[2] = max(node[2], k)
            for c in term:
                node = node[0].setdefault(c, self._node())
                node[2] = max(node[2], k)
            node[1].append(term)

    @staticmethod
    def _node() -> list:
        return [{}, [], 0]

    def near(self, word: str) -> list[tuple[str, int]]:
        """(term, distance) of all terms within the edits that they may have."""
        found = []
        stack = [(self.root, list(range(len(word) + 1)))]
        while stack:
            (children, ends, _), states = stack.pop()
            found.extend((t, states[-1]) for t in ends if states[-1] <= allowed(t))
            for c, child in children.items():
                row = [states[0] + 1]
                least = row[0]
                for i, w in enumerate(word):
                    d = min(row[i] + 1, states[i + 1] + 1, states[i] + (w != c))
                    row.append(d)
                    least = d if d < least else least
                if least <= child[2]:
                    stack.append((child, row))
        return found


BASE = np.uint64(0x9E3779B97F4A7C15)
#: Numbers in an array of hashes at once.
HASHES = 1 << 18


def deletion_hashes(words: list[str], k: int) -> np.ndarray:
    """Hashes of words of one length, a row each, with up to ``k`` (0, 1 or 2) letters taken out in every way."""
    n = len(words[0])
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), n)
    power = np.cumprod(np.append(np.uint64(1), np.full(n + 1, BASE)), dtype=np.uint64)
    before = np.zeros((len(words), n + 1), dtype=np.uint64)  # hash of the letters before each place
    for i in range(n):
        before[:, i + 1] = before[:, i] * BASE + chars[:, i] + np.uint64(1)
    out = [before[:, n:]]
    if k and n:
        # Without letter i: what stands before it, moved up by what stands behind it, and that.
        shift = power[n - 1 - np.arange(n)]
        behind = before[:, n:] - before[:, 1:] * shift
        one = before[:, :n] * shift + behind
        out.append(one)
        if k > 1 and n > 1:
            i, j = np.triu_indices(n, 1)
            step = (before[:, :n - 1] - before[:, 1:n]) * power[n - 2 - np.arange(n - 1)]
            out.append(step[:, i] + one[:, j])
    return np.concatenate(out, axis=1)


class Lexicon:
    """The terms, by what deletions leave of them."""

    def __init__(self, terms):
        self.by_rest: dict[str, list[str]] = {}
        self.long = [t for t in terms if len(t) > LONG_TERM]
        lengths: dict[int, int] = {}  # most edits that may lead to a term, by the word's length
        for term in terms:
            k = allowed(term)
            for n in range(max(0, len(term) - k), len(term) + k + 1):
                lengths[n] = max(lengths.get(n, 0), k)
            if len(term) <= LONG_TERM:
                for rest in deletions(term, k) if k else ():
                    self.by_rest.setdefault(rest, []).append(term)
        self.edits = {n: k for n, k in lengths.items() if k}
        # The rests' hashes, and a table with a bit for each, which most other hashes miss.
        bits = max(16, int(np.ceil(np.log2(max(1, len(self.by_rest)) * 32))))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, dtype=bool)
        by_length: dict[int, list[str]] = {}
        for rest in self.by_rest:
            by_length.setdefault(len(rest), []).append(rest)
        hashes = [deletion_hashes(rests, 0)[:, 0] for rests in by_length.values()]
        self.hashes = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *hashes]))
        self.table[self._places(self.hashes)] = True

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        return (((hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> self.shift).astype(np.int64)

    def may_meet(self, words: list[str]) -> list[str]:
        """``words`` without most of those that are near no term; no other is left out."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            if len(w) in self.edits:
                by_length.setdefault(len(w), []).append(w)
        out = []
        for n, some in by_length.items():
            if n > LONG_TERM + 2 or any(abs(len(t) - n) <= self.edits[n] for t in self.long):
                out += some
                continue
            step = max(1, HASHES // (n * n + 1))
            for a in range(0, len(some), step):
                hashes = deletion_hashes(some[a:a + step], self.edits[n])
                word, which = np.nonzero(self.table[self._places(hashes)])
                found = hashes[word, which]
                at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
                out += [some[a + k] for k in np.unique(word[self.hashes[at] == found]).tolist()] if len(word) else []
        return out

    def near(self, word: str) -> list[tuple[str, int]]:
        """(term, distance) of all terms within the edits that they may have."""
        k = self.edits.get(len(word))
        if not k:
            return []
        part = {t for t in self.long if abs(len(t) - len(word)) <= k}
        if len(word) <= LONG_TERM + 2:
            for rest in deletions(word, k):
                part.update(self.by_rest.get(rest, ()))
        return Trie(part).near(word) if part else []

    def closest(self, word: str, weights: dict[str, float]) -> tuple[str, int] | None:
        """The term that ``word`` is or is a misspelled form of, and the distance."""
        if word in weights:
            return word, 0
        near = [] if word.isdigit() else self.near(word)
        return min(near, key=lambda x: (x[1], -weights[x[0]], x[0])) if near else None


@dataclass
class Model:
    """Term weights, the trust in misspelled forms by term, ordinary words near terms, and the regression."""

    weights: dict[str, float]
    trust: dict[str, float] = field(default_factory=dict)
    ordinary: frozenset[str] = frozenset()
    evidence: Evidence | None = None

    def __post_init__(self):
        self.lexicon = Lexicon(self.weights)

    def __getstate__(self):
        return self.weights, self.trust, self.ordinary, self.evidence

    def __setstate__(self, state):
        self.weights, self.trust, self.ordinary, self.evidence = state
        self.__post_init__()

    def look_up(self, words: set[str]) -> dict[str, tuple[str, int]]:
        """Of ``words``, those that stand for a term: the term and the distance."""
        out = {w: (w, 0) for w in words if w in self.weights}
        others = [w for w in words if w not in self.weights and w not in self.ordinary]
        for w in self.lexicon.may_meet(others):
            hit = self.lexicon.closest(w, self.weights)
            if hit:
                out[w] = hit
        return out

    def features(self, texts: list[str | None]) -> list[list[float]]:
        """What the regression sees of each text."""
        lower = [(t or "").lower() for t in texts]
        words = [WORD.findall(t) for t in lower]
        matched = self.look_up(set().union(*words))
        return [self._features(t, w, matched) for t, w in zip(lower, words)]

    def _features(self, lower: str, words: list[str], matched: dict[str, tuple[str, int]]) -> list[float]:
        if not matched or matched.keys().isdisjoint(words):
            return [0.0] * 7
        spans = [m.span() for m in WORD.finditer(lower)]
        hits = [(at, *matched[w]) for at, w in enumerate(words) if w in matched]
        found, fuzzy, quoted, aimed, most = [], 0.0, 0.0, 0, 0.0
        for at, term, distance in hits:
            share = context(lower, spans, at)
            aimed += share[1]
            quoted += share[0]
            weight = self.weights[term] if not distance else max(0.0, self.trust.get(term, 0.0)) / distance
            weight *= 1 - 0.8 * share[0]
            found.append(weight)
            fuzzy += weight * (distance > 0)
            most = max(most, weight)
        n = len(hits)
        return [most, np.log1p(sum(found)), np.log1p(fuzzy), float(len({h[1] for h in hits})),
                quoted / n, aimed / n, np.log1p(sum(found)) / np.log(2 + len(lower) / 6)]

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.evidence is None:
            return np.zeros(len(texts))
        x = np.array(self.features(texts), dtype=np.float64).reshape(len(texts), 7)
        return 1 / (1 + np.exp(-self.evidence.logit(x)))


def context(text: str, spans: list[tuple[int, int]], at: int) -> tuple[float, int]:
    """(share that speaks for quotation, 1 if someone is addressed) in the window of ``SPAN`` words around word ``at``."""
    first, last = max(0, at - SPAN), min(len(spans) - 1, at + SPAN)
    before = text[spans[first - 1][1] if first else 0:spans[at][0]]
    after = text[spans[at][1]:spans[last + 1][0] if last + 1 < len(spans) else len(text)]
    words = {text[a:b] for a, b in spans[first:at] + spans[at + 1:last + 1]}
    opened = sum(c in QUOTES for c in before) % 2 == 1 and any(c in QUOTES for c in after)
    return min(1.0, 0.8 * opened + 0.4 * bool(words & REPORTING)), int(bool(words & ADDRESSING))


def held_out(id_col: str) -> F.Column:
    """Rows that no model learns from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: str, most: int) -> DataFrame:
    """(text, y) of at most ``most`` labelled rows that are not held out, equal texts with one label once; written."""
    marked = labels.where(F.col(label).isin(0, 1) & ~held_out(id_col)).select(
        F.col(id_col).alias("id"), F.col(label).cast("long").alias("y"))
    chosen = marked.orderBy(F.xxhash64("id"), "id", "y").limit(most)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())
    rows = cut(texts.join(F.broadcast(chosen), "id").select("text", "y"), "labelled")
    return cut(rows.groupBy(F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"), "y").agg(
        F.first("text").alias("text")).select("text", "y"), "sample")


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, a, b): in how many toxic and in how many other texts of ``rows`` (text, y) a word stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [pa.array(set(WORD.findall(t.lower())), pa.string()) for t in batch.column("text").to_pylist()]
            y = np.repeat(batch.column("y").to_numpy(), [len(w) for w in found])
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(found), pa.array(y)], names=["word", "y"])

    return rows.mapInArrow(run, "word string, y long").groupBy("word").agg(
        F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b"))


def terms(counts: DataFrame, toxic: float, clean: float) -> dict[str, float]:
    """Terms and their log-odds, from the word counts of ``toxic`` and ``clean`` texts."""
    if not toxic or not clean:
        return {}
    a, b = F.col("a"), F.col("b")
    rate = toxic / (toxic + clean)
    gain = lambda x, share: F.when(x > 0, x * F.log(x / ((a + b) * share))).otherwise(0.0)
    scored = counts.where((a >= 3) & (a >= PRECISION * (a + b))).select(
        "word", (2 * (gain(a, rate) + gain(b, 1 - rate))).alias("g2"),
        (F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (clean + 1))).alias("weight"))
    least = 2 * np.log(max(2, counts.count())) + 4
    return {r["word"]: float(r["weight"]) for r in scored.where(F.col("g2") >= float(least)).collect()}  # of the sample


def forms(counts: DataFrame, model: Model) -> list:
    """(word, term, a, b) of the sample's words near a term."""
    shared = counts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            hits = {w: term for w, (term, distance) in shared.value.look_up(set(words)).items() if distance}
            rows = batch.filter(pa.array([w in hits for w in words]))
            yield pa.RecordBatch.from_arrays(
                [rows.column("word"), pa.array([hits[w] for w in words if w in hits], pa.string()),
                 rows.column("a"), rows.column("b")], names=["word", "term", "a", "b"])

    return counts.mapInArrow(run, "word string, term string, a double, b double").collect()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label: str = "toxic", most: int = MAX_LABELLED) -> Model:
    """Learn from the labelled rows that are not held out."""
    rows = sample(docs, labels, id_col, text_col, label, most)
    counts = cut(word_counts(rows), "words")
    toxic, clean = (float(x or 0) for x in rows.select(F.sum("y"), F.sum(1 - F.col("y"))).first())
    weights = terms(counts, toxic, clean)
    if not weights:
        return Model({})
    seen, ordinary = {}, set()
    for r in forms(counts, Model(weights)):
        if r["b"] >= 2 and r["a"] < PRECISION * (r["a"] + r["b"]):
            ordinary.add(r["word"])
        else:
            a, b = seen.get(r["term"], (0.0, 0.0))
            seen[r["term"]] = (a + r["a"], b + r["b"])
    trust = {t: float(np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1))) for t, (a, b) in seen.items()}
    # A term without misspelled forms in the sample is trusted as far as those of the others are, on average.
    share = float(np.clip(np.mean([v / weights[t] for t, v in trust.items()]), 0, 1)) if trust else UNSEEN_TRUST
    model = Model(weights, {t: trust.get(t, w * share) for t, w in weights.items()}, frozenset(ordinary))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = shared.value.features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    got = rows.mapInArrow(look, "y long, x array<double>").toPandas()  # at most ``most`` rows
    y = got["y"].to_numpy(dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return Model({})
    x = np.stack(got["x"].to_numpy())
    order = np.lexsort((*x.T, y))  # so that sums do not depend on the tasks' order
    model.evidence = Evidence.fit(x[order], y[order])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(shared.value.score(batch.column("text").to_pylist()))],
                names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double").select(
        F.col("id").alias(id_col), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
