"""Connected components of a distributed edge table by alternating large and small stars.

Every round connects each node's larger neighbours to its least neighbour
(large star), then each node's smaller neighbours and itself to the least of
them (small star), until the edges stay the same: then each node has one edge,
to the least node of its component. Edges never leave the executors; minima are
grouped with partial sums, and joined to the edges as a written table, so that
adaptive skew handling can split the rows of a node with many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.lineage import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); the component is its least node."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
            "edges")
    state = _state(e)
    while state[0]:
        both = e.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(
            e.select(F.col("v").alias("node"), F.col("u").alias("other")))
        least = cut(both.groupBy("node").agg(F.min("other").alias("o"))
                    .select("node", F.least("node", "o").alias("low")), "large")
        large = cut(both.join(least, "node").where("other > node")
                    .select(F.col("other").alias("u"), F.col("low").alias("v")).distinct(), "edges")
        low = cut(large.groupBy("u").agg(F.min("v").alias("low")), "small")
        e = cut(large.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
                .unionByName(low.select("u", F.col("low").alias("v"))).distinct(), "edges")
        state, last = _state(e), state
        if state == last:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
