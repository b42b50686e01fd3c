"""Quality classifier by hierarchical empirical Bayes: document evidence with host and path posteriors.

A logistic regression on text statistics, fitted on all labelled rows (each step of
Newton's method is a sum over tasks), gives each document a probability of good quality. The
mean of these over all documents is the global prior. Each host's rate is
shrunk toward it, and each path's rate toward its host's, as if ``k`` more
documents of the parent had been seen; both ``k`` come from the method of
moments over all hosts and all paths (wide differences between sites: small
``k``), so sparse sites stay near the prior. The final score is the document's
likelihood ratio times the odds of its path, without the document itself.

Sums are grouped by (host, path) before anything is shuffled, so a host with a
third of all rows adds one row per task; hosts and the global prior are sums of
those rows.

``documents`` have no URL: the host is ``source``, the path ``lang``.

Defined cases: NULL hosts and paths are sites of their own; NULL and empty texts
are scored by their (zero) statistics; without labelled rows of both classes the
evidence is 0.5 for all, and all are kept; repeated rows get equal results; an
empty table gives an empty result; other columns cannot clash (rows are packed, or
the names avoided). Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.flat import add_columns, fresh
from gleaner.llm.lineage import cut
from gleaner.llm.text_stats import STATS, labelled, over_all, ratios, stats_of, stored_stats

RIDGE = 1.0
#: Bounds of the prior strengths; the evidence stays within these log-odds.
WEAKEST, STRONGEST, MOST_LOGIT = 1.0, 1e6, 12.0
KEEP_FROM = 0.5


def features(stats: np.ndarray) -> np.ndarray:
    r = ratios(stats)
    rising = lambda x: x / (x + 0.05)
    return np.column_stack([r, rising(r[:, 2]), rising(r[:, 3]), rising(r[:, 4]), rising(r[:, 5]),
                            rising(r[:, 6]), stats[:, 0] < 10])


@dataclass
class Evidence:
    """A logistic regression and the share of good rows it was fitted on."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    base: float

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray) -> Evidence:
        """Of rows in memory."""
        return Evidence.of(lambda part: part(x, y) if len(y) else None, x.shape[1])

    @staticmethod
    def of(total: Callable, k: int) -> Evidence:
        """Of rows anywhere: ``total(part)`` adds ``part(x, y)`` up over all of them (None without rows)."""
        sums = total(lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(axis=0)]))
        if sums is None or sums[1] in (0, sums[0]):
            return Evidence(np.zeros(k), np.ones(k), np.zeros(k + 1), 0.5)
        n, mean = sums[0], sums[2:] / sums[0]
        scale = np.maximum(np.sqrt(total(lambda x, y: ((x - mean) ** 2).sum(axis=0)) / n), 1e-6)
        w, penalty = np.zeros(k + 1), RIDGE * np.append(np.ones(k), 1e-6)

        def newton(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            return np.concatenate([((z * (p * (1 - p))[:, None]).T @ z).ravel(), z.T @ (y - p)])

        for _ in range(50):  # Newton's method
            found = total(newton)
            step = np.linalg.solve(found[:-k - 1].reshape(k + 1, k + 1) + np.diag(penalty),
                                   found[-k - 1:] - penalty * w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        return Evidence(mean, scale, w, float(sums[1] / n))

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -MOST_LOGIT, MOST_LOGIT)


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id") -> Evidence:
    """Fit on all labelled rows of :func:`stored_stats`; sums over tasks, one row a task and a pass to the driver."""
    rows = labelled(stats, labels, label, id_col)
    return Evidence.of(lambda part: over_all(rows, lambda s, y: part(features(s), y)),
                       features(np.zeros((1, len(STATS)), dtype=np.int64)).shape[1])


def stats_evidence(stats: DataFrame, model: Evidence, name: str) -> DataFrame:
    """``stats`` with the model's log-odds of each row in a column ``name`` in place of STATS."""
    kept = [c for c in stats.columns if c not in STATS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STATS])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(model.logit(features(s)))],
                                             names=[*kept, name])

    return stats.mapInArrow(run, T.StructType([*(stats.schema[c] for c in kept), T.StructField(name, T.DoubleType())]))


def with_evidence(docs: DataFrame, model: Evidence, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` and the model's log-odds of each text in a column ``name``."""
    return add_columns(docs, text_col, f"`{name}` double",
                       lambda texts: [pa.array(model.logit(features(stats_of(texts))))])


def strength(n: str, good: str, prior) -> F.Column:
    """Prior strength by the method of moments, as an aggregate over groups.

    ``n`` and ``good`` are a group's rows and sum of probabilities, ``prior`` the
    rate it is shrunk to. The spread of the groups' rates beyond what their sizes
    explain is the variance between groups.
    """
    size, chance = F.col(n), prior * (1 - prior)
    spread = F.sum(size * F.pow(F.col(good) / size - prior, 2))
    between = (spread - F.sum(chance)) / F.greatest(
        F.lit(1e-9), F.sum(size) - F.sum(size * size) / F.sum(size))
    return F.when(between > 0, F.least(F.lit(STRONGEST), F.greatest(
        F.lit(WEAKEST), F.avg(chance) / between - 1))).otherwise(F.lit(STRONGEST))


def site_rates(rows: DataFrame, host: str, path: str, p: str) -> DataFrame:
    """(host, path, n_path, good_path, host_rate, k_path) of every site in ``rows``; ``p`` is a probability."""
    paths = rows.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(p).alias("good"))
    paths = cut(paths, "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n_host"), F.sum("good").alias("good_host"))
    total = hosts.agg(F.sum("good_host").alias("g"), F.sum("n_host").alias("n")).first()
    prior = total["g"] / total["n"] if total["n"] else 0.5
    k_host = hosts.agg(strength("n_host", "good_host", F.lit(prior)).alias("k")).first()["k"] or STRONGEST
    rates = hosts.select(F.col("host").alias("of"), (
        (F.col("good_host") + k_host * prior) / (F.col("n_host") + k_host)).alias("host_rate"))
    both = paths.join(rates, F.col("host").eqNullSafe(F.col("of"))).drop("of")
    k_path = both.agg(strength("n", "good", F.col("host_rate")).alias("k")).first()["k"] or STRONGEST
    # Written, so that its size is known: where it is small, texts are not shuffled to meet it.
    return cut(both.select("host", "path", F.col("n").alias("n_path"), F.col("good").alias("good_path"),
                           "host_rate", F.lit(float(k_path)).alias("k_path")), "rates")


def combine(rows: DataFrame, rates: DataFrame, host: str, path: str, logit: str, base: float) -> DataFrame:
    """``rows`` and the columns host_rate, path_rate, score and kept (rates' columns gone)."""
    odds = lambda p: F.log(p / (1 - p))
    own = 1 / (1 + F.exp(-F.col(logit)))
    path_rate = (F.col("good_path") - own + F.col("k_path") * F.col("host_rate")) / (
        F.col("n_path") - 1 + F.col("k_path"))
    held = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("path_rate")))
    prior = np.log(base / (1 - base))
    kept_cols = [F.col(c) for c in rows.columns]
    return (rows.join(rates, F.col(host).eqNullSafe(F.col("host")) & F.col(path).eqNullSafe(F.col("path")), "left")
            .withColumn("path_rate", path_rate)
            .withColumn("score", 1 / (1 + F.exp(-(F.col(logit) - F.lit(float(prior)) + odds(held)))))
            .withColumn("kept", F.col("score") >= KEEP_FROM)
            .select(*kept_cols, "host_rate", "path_rate", "score", "kept"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """(id, evidence, host_rate, path_rate, score, kept) of every document."""
    stats = stored_stats(docs, {"id": id_col, "host": host_col, "path": path_col}, text_col)
    model = fit(stats, labels, id_col=id_col)
    rows = stats_evidence(stats, model, "_logit").select(
        F.col("id").alias("_id"), F.col("host").alias("_host"), F.col("path").alias("_path"), "_logit")
    rows = cut(rows, "evidence")
    rates = site_rates(rows.withColumn("_p", 1 / (1 + F.exp(-F.col("_logit")))), "_host", "_path", "_p")
    out = combine(rows, rates, "_host", "_path", "_logit", model.base)
    return out.select(F.col("_id").alias(id_col), (1 / (1 + F.exp(-F.col("_logit")))).alias("evidence"),
                      "host_rate", "path_rate", "score", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", host_col: str = "source",
              path_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns."""
    stats = stored_stats(docs, {"id": id_col, "host": host_col, "path": path_col}, text_col)
    model = fit(stats, labels, id_col=id_col)
    host, path, logit = (fresh(docs, x) for x in ("_site_host", "_site_path", "_site_logit"))
    only = stats_evidence(stats, model, "_logit").select(
        F.col("host").alias("_host"), F.col("path").alias("_path"), (1 / (1 + F.exp(-F.col("_logit")))).alias("_p"))
    rates = site_rates(only, "_host", "_path", "_p")
    scored = with_evidence(docs, model, logit, text_col)
    # Names of docs may clash with those of combine(): its inputs carry one packed row.
    packed = scored.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                           F.col(f"`{host_col}`").alias(host), F.col(f"`{path_col}`").alias(path), F.col(logit))
    return combine(packed, rates, host, path, logit, model.base).where("kept").select("_row.*")
