"""Quality rules and an isolation forest on their statistics.

Fixed rules reject a text with too few words or too many repeated ones. An
isolation forest then looks at the statistics as ratios. Its trees split regions
of the feature space, whose bounds are those of all labelled rows, at random
places, and count all rows labelled 1: where none is, a region is isolated after
few steps, so the path of an anomalous text is short even if there are many alike
(trees over all rows see a cluster of junk as normal: on the given labels they
kept most of it). An isolation forest draws a subsample a tree; here no row is
drawn: splits need no rows, only bounds, so whole trees are made first, tasks
count their rows in every leaf, and a region's rows count by their share of all,
in the size that a subsample would have (``SUBSAMPLE``). The threshold on the
anomaly score is the one that separates rows labelled 0 from rows labelled 1 best
(Youden's index) among those that keep at least ``KEEP_GOOD`` of the rows
labelled 1; it is sought at the edges of ``SCORE_CELLS`` cells, over the counts of
all labelled rows. Splits are drawn from a seed, so reruns agree. The trees (a
few hundred KB) go to the tasks; statistics are taken where texts are read, and
written; only these are joined with the labels.

Defined cases: NULL and empty texts have no words and fail the fixed rules;
without labelled rows of both classes the forest keeps all; repeated rows get
equal results; an empty table gives an empty result. Only the id and text
columns are read, so other columns cannot clash. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.flat import slices
from gleaner.llm.text_stats import STATS, arrays, labelled, over_all, ratios, stats_of, stored_stats

TREES = 200
SUBSAMPLE = 256
KEEP_GOOD = 0.995
SEED = 17
#: Cells of the anomaly score at whose edges the threshold is sought.
SCORE_CELLS = 1 << 16
#: Number of features.
WIDTH = 7
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of ``n`` rows."""
    n = np.asarray(n, dtype=np.float64)
    m = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as flat arrays: feature (-1 in a leaf), threshold, first child (the second follows), path length."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    path: np.ndarray
    subsample: int

    @staticmethod
    def shape(low: np.ndarray, high: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE,
              seed: int = SEED) -> Forest:
        """Whole trees that split the box from ``low`` to ``high`` at random; their paths are still to be counted."""
        rng = np.random.default_rng(seed)
        wide = np.flatnonzero(high > low)
        depth = max(1, int(np.ceil(np.log2(max(subsample, 2))))) if len(wide) else 0
        inner, every = 2 ** depth - 1, np.arange(trees)
        feature = np.full((trees, 2 * inner + 1), -1, dtype=np.int32)
        threshold, child = np.zeros(feature.shape), np.zeros(feature.shape, dtype=np.int32)
        lo, hi = (np.repeat(np.asarray(x, dtype=np.float64)[None, None], trees, 0).repeat(2 * inner + 1, 1)
                  for x in (low, high))
        for node in range(inner):
            f = rng.choice(wide, trees)
            t = rng.uniform(lo[every, node, f], hi[every, node, f])
            feature[:, node], threshold[:, node], child[:, node] = f, t, 2 * node + 1
            for half in (2 * node + 1, 2 * node + 2):
                lo[:, half], hi[:, half] = lo[:, node], hi[:, node]
            hi[every, 2 * node + 1, f] = t
            lo[every, 2 * node + 2, f] = t
        return Forest(feature, threshold, child, np.zeros(feature.shape), subsample)

    def leaves(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """The leaf that each row falls in, tree by tree."""
        every = np.arange(len(rows))
        for feature, threshold, child in zip(self.feature, self.threshold, self.child):
            node = np.zeros(len(rows), dtype=np.int32)
            while (inner := feature[node] >= 0).any():
                step = child[node] + (rows[every, np.maximum(feature[node], 0)] > threshold[node])
                node = np.where(inner, step, node)
            yield node

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """How many of ``rows`` fall in each leaf of each tree."""
        return np.stack([np.bincount(node, minlength=self.feature.shape[1]) for node in self.leaves(rows)])

    def grown(self, counts: np.ndarray) -> Forest:
        """The trees with the paths that ``counts`` of whole trees give.

        A region that less than two rows in a subsample's size share is not split further; regions count with all
        their rows, as the mean of all subsamples has them.
        """
        counts = counts.astype(np.float64)
        n = int(counts[0].sum())
        size = min(self.subsample, n)
        share, feature, path = size / max(n, 1), self.feature.copy(), np.zeros(counts.shape)
        for node in reversed(range(counts.shape[1] // 2)):
            counts[:, node] = counts[:, 2 * node + 1] + counts[:, 2 * node + 2]
        for node in range(counts.shape[1]):
            leaf = (counts[:, node] * share < 2) | (self.feature[:, node] < 0)
            path[:, node] = np.where(leaf, int(np.log2(node + 1)) + mean_path(counts[:, node] * share), 0)
            feature[leaf, node] = -1
        return Forest(feature, self.threshold, self.child, path, size)

    @staticmethod
    def fit(rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES,
            subsample: int = SUBSAMPLE, seed: int = SEED) -> Forest:
        """Trees over ``rows``, all of them, that split the box from ``low`` to ``high``."""
        shape = Forest.shape(low, high, trees, min(subsample, len(rows)), seed)
        return shape.grown(shape.counts(rows))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score of each row: near 1 for short paths, below 0.5 for long ones."""
        total = np.zeros(len(rows))
        for path, node in zip(self.path, self.leaves(rows)):
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / max(float(mean_path(self.subsample)), 1e-9))


@dataclass
class Rules:
    """A fitted forest and its threshold; ``forest`` is None if there was nothing to calibrate with."""

    forest: Forest | None
    threshold: float


def calibrate(score: np.ndarray, good: np.ndarray, keep_good: float = KEEP_GOOD,
              rows: np.ndarray | None = None) -> float:
    """The score above which a row is rejected; ``rows`` is how many rows have each (score, good), one by default."""
    rows = np.ones(len(score)) if rows is None else rows
    if not good.any() or good.all():
        return float("inf")
    cuts, at = np.unique(score, return_inverse=True)
    kept_good, kept_bad = (np.cumsum(np.bincount(at[g], rows[g], len(cuts))) / rows[g].sum() for g in (good, ~good))
    gain = np.where(kept_good >= keep_good, kept_good - kept_bad, -1)
    return float(cuts[int(np.argmax(gain))])


def features(stats: np.ndarray) -> np.ndarray:
    """The rules' statistics, each from 0 to 1: symbols, repeated lines, repeated words, capitals, exclamations, mean
    length of a word and number of words (both logarithmic)."""
    r = ratios(stats)
    rising = lambda x: x / (x + 0.05)
    size = lambda x, most: np.minimum(1.0, np.log1p(x) / np.log(most))
    return np.column_stack([rising(r[:, 2]), r[:, 3], r[:, 4], r[:, 5], rising(r[:, 6]),
                            size(r[:, 1], 200), size(stats[:, 0].astype(np.float64), 1e6)])


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > MAX_REPEAT_PERCENT * stats[:, 0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id",
        text_col: str = "text") -> Rules:
    """Fit on all labelled documents."""
    return fit_stats(stored_stats(docs, {"id": id_col}, text_col), labels, label, id_col)


def fit_stats(stats: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id") -> Rules:
    """Fit on all labelled rows of :func:`stored_stats`: bounds, trees' counts and threshold are sums over tasks."""
    rows = labelled(stats, labels, label, id_col)

    def bounds(stats: np.ndarray, y: np.ndarray) -> np.ndarray:
        passed = ~base_failed(stats)
        good, x = y[passed] == 1, features(stats[passed])
        if not len(x):
            return np.full(2 + 2 * WIDTH, np.inf)
        # Least values alone: that any is good or bad is a 0, highest values are negated.
        return np.concatenate([[0.0 if good.any() else np.inf, 0.0 if (~good).any() else np.inf],
                               x.min(axis=0), -x.max(axis=0)])

    found = over_all(rows, bounds, np.minimum)
    if found is None or np.isinf(found).any():
        return Rules(None, float("inf"))
    shape = Forest.shape(found[2:2 + WIDTH], -found[2 + WIDTH:])

    def counted(stats: np.ndarray, y: np.ndarray) -> np.ndarray:
        return shape.counts(features(stats[~base_failed(stats) & (y == 1)])).ravel()

    # TREES * 2 * SUBSAMPLE counts a task, added up by the tasks of a shuffle.
    forest = shape.grown(counts_over_all(rows, counted, shape.feature.shape))
    cells = anomaly_cells(rows, forest).toPandas()  # at most two rows a cell of SCORE_CELLS
    score, good = cells["cell"].to_numpy() / SCORE_CELLS, cells["good"].to_numpy(dtype=bool)
    return Rules(forest, calibrate(score, good, rows=cells["n"].to_numpy(dtype=np.float64)))


def counts_over_all(rows: DataFrame, counted, shape: tuple[int, int]) -> np.ndarray:
    """Counts by place, added up over all labelled rows; the driver gets one number a place that has rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(shape[0] * shape[1], dtype=np.int64)
        for batch in batches:
            held += counted(*arrays(batch))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["place", "n"])

    sums = rows.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(shape[0] * shape[1], dtype=np.int64)
    out[sums["place"].to_numpy(dtype=np.int64)] = sums["n"].to_numpy(dtype=np.int64)
    return out.reshape(shape)


def anomaly_cells(rows: DataFrame, forest: Forest) -> DataFrame:
    """(cell, good, n): how many labelled rows that pass the fixed rules score in each cell, by label."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)  # at most TREES * 2 * SUBSAMPLE nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats, y = arrays(batch)
            passed = ~base_failed(stats)
            cell = np.ceil(shared.value.score(features(stats[passed])) * SCORE_CELLS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(y[passed] == 1)], names=["cell", "good"])

    return rows.mapInArrow(run, "cell long, good boolean").groupBy("cell", "good").agg(F.count(F.lit(1)).alias("n"))


def judged(stats: np.ndarray, rules: Rules) -> list[pa.Array]:
    """base_failed, anomaly and kept of each row of STATS."""
    failed = base_failed(stats)
    anomaly = rules.forest.score(features(stats)) if rules.forest else np.zeros(len(stats))
    return [pa.array(failed), pa.array(anomaly), pa.array(~failed & (anomaly <= rules.threshold))]


def _verdicts(rows: DataFrame, rules: Rules, of_batch, id_col: str) -> DataFrame:
    names = STATS[:5]
    shared = rows.sparkSession.sparkContext.broadcast(rules)  # at most TREES * 2 * SUBSAMPLE nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, stats in of_batch(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(stats[:, k]) for k in range(5)), *judged(stats, shared.value)],
                names=["id", *names, "base_failed", "anomaly", "kept"])

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, anomaly double, kept boolean"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def apply(docs: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the five rule statistics, base_failed, anomaly, kept) of every row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _verdicts(rows, rules, lambda batches: ((b, stats_of(b.column("text"))) for b in slices(batches, "text")), id_col)


def verdicts(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """:func:`fit` and :func:`apply`, with the statistics of the texts taken once."""
    stats = stored_stats(docs, {"id": id_col}, text_col)
    return _verdicts(stats, fit_stats(stats, labels, label, id_col), lambda batches: (
        (b, np.column_stack([b.column(s).to_numpy(zero_copy_only=False) for s in STATS])) for b in batches), id_col)
