"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosine, connected components.

Equal vectors with equal labels are one class, so a vector that a third of all
rows hold is one row from then on. The signs of a class's projections on
``bits`` random hyperplanes are its key in a table; there are as many tables as
make a pair at the threshold miss all of them at most once in ``1 / MISS``. Bits grow with
the logarithm of the number of classes, so that classes without likeness seldom
share a bucket, and the tables with them, which keeps the bound.

Buckets are found on classes' names and keys alone; only classes that share one
bring their vector there. Classes with equal label, table and key are compared in
blocks of bounded size by the exact cosine in double precision. A pair counts in the first table where
its keys are equal, so links are summed without a list of pairs: a block gives
each class its links (weighted by copies) and the least class it is linked with.
Components are found distributed on those edges, at most one per class and block.

A class's links inside a block are connected through edges to the roots of a
union-find over the block's links, so no connection is lost.

Defined cases: vectors that are NULL, empty, zero or hold NULL or non-finite
components, and vectors without a label, link with nothing; vectors of another
length than the first sampled one link with nothing of other lengths; rows that
share an id are separate vectors; rows without an id count as links but are named
by no component; an empty table gives an empty result; only the id, vector and label
columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner.llm.blocks import by_block, in_blocks, whole_groups
from gleaner.llm.components import components
from gleaner.llm.lineage import cut

COSINE = 0.98
MISS = 1e-6
SEED = 23
BLOCK = 1024
#: Classes of a bucket if none were alike: few share one by chance.
BUCKET = 1 / 16
BLOCK_KEYS = ["label", "t", "key", "low", "high"]


def plan(classes: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for so many classes."""
    bits = min(28, max(8, math.ceil(math.log2(max(classes, 1) / BUCKET))))
    hit = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - hit))


def planes(width: int, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, width]).standard_normal((width, bits * tables))


def checked(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, key, vector): key is a hash of a vector that may link, else NULL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            column = batch.column("vector")
            flat = pc.fill_null(column.values.cast(pa.float64()), np.nan).to_numpy() + 0.0  # no -0.0
            ends = column.offsets.to_numpy()
            known = column.is_valid().to_numpy(zero_copy_only=False) & \
                batch.column("label").is_valid().to_numpy(zero_copy_only=False)
            keys, kept = [], []
            for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), known.tolist()):
                x = flat[a:b]
                ok = ok and bool(np.isfinite(x).all()) and bool(x.any())
                keys.append(xxhash.xxh3_128_digest(x.tobytes()) if ok else None)
                kept.append(x if ok else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(keys, pa.binary()),
                 pa.array(kept, pa.list_(pa.float64()))], names=["id", "label", "key", "vector"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"),
                          F.col(label_col).cast("string").alias("label"))
    return rows.mapInArrow(run, "id long, label string, key binary, vector array<double>")


def hashed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """``classes`` (rep, label, copies, vector) and signs: the key in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (1 << np.arange(bits, dtype=np.int64))
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = batch.column("vector").to_numpy(zero_copy_only=False)
            width = np.array([len(r) for r in rows])
            signs = np.zeros((len(rows), tables), dtype=np.int64)
            for w in np.unique(width).tolist():
                if w not in held:
                    held[w] = planes(w, bits, tables)
                at = np.flatnonzero(width == w)
                signs[at] = (np.stack(rows[at]) @ held[w] > 0).reshape(len(at), tables, bits) @ weights
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(signs), pa.list_(pa.int64()))],
                                             names=[*batch.schema.names, "signs"])

    added = StructType.fromDDL("signs array<bigint>")
    return classes.mapInArrow(run, StructType(classes.schema.fields + added.fields))


def links(members: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(rep, links, root) of each class with links in a block of ``members``, links weighted by copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, BLOCK_KEYS):
            rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
            t, chunk = table.column("t").to_numpy(), table.column("chunk").to_numpy()
            cross = table.column("low").to_numpy() != table.column("high").to_numpy()
            signs = table.column("signs").combine_chunks()
            vector = table.column("vector").combine_chunks()
            out = []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                s = np.stack(signs.slice(lo, hi - lo).to_numpy(zero_copy_only=False))
                rows = vector.slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                width = np.array([len(r) for r in rows])
                for w in np.unique(width):
                    at = np.flatnonzero(width == w)
                    x = np.stack(rows[at])
                    x = x / np.sqrt((x * x).sum(axis=1))[:, None]
                    i, j = np.nonzero(np.triu(x @ x.T >= cosine, 1))
                    i, j = at[i], at[j]
                    if cross[lo]:
                        apart = chunk[lo + i] != chunk[lo + j]
                        i, j = i[apart], j[apart]
                    earlier = (s[i, :t[lo]] == s[j, :t[lo]]).any(axis=1) if t[lo] else np.zeros(len(i), dtype=bool)
                    i, j = i[~earlier], j[~earlier]
                    if len(i):
                        n = np.zeros(hi - lo, dtype=np.int64)
                        np.add.at(n, i, copies[lo + j])
                        np.add.at(n, j, copies[lo + i])
                        root = _roots(i, j, rep[lo:hi])
                        out.extend((int(rep[lo + k]), int(n[k]), root[k]) for k in np.flatnonzero(n).tolist())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)],
                                             names=["rep", "links", "root"])

    return members.mapInArrow(run, "rep long, links long, root long")


def _roots(i: np.ndarray, j: np.ndarray, rep: np.ndarray) -> dict[int, int]:
    """The least rep that each linked row of a block reaches by the block's links."""
    low = rep.copy()
    while True:
        before = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        if (low == before).all():
            return {int(k): int(low[k]) for k in np.unique(np.concatenate([i, j]))}


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    rows = cut(checked(vectors, id_col, vector_col, label_col), "vectors")
    classes = cut(rows.where("key IS NOT NULL").groupBy("label", "key").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
        .where("rep IS NOT NULL"), "classes")
    bits, tables = plan(classes.count(), cosine)
    signed = cut(hashed(classes.select("rep", "label", "copies", "vector", F.col("key").alias("class")), bits, tables), "signs")
    keyed = signed.select("rep", "class", "label", F.posexplode("signs").alias("t", "key"))
    shared = cut(in_blocks(keyed, ["label", "t", "key"], "class", BLOCK).drop("rep"), "shared")
    members = shared.join(signed, ["label", "class"]).drop("class")
    found = cut(links(by_block(members, BLOCK_KEYS), cosine), "links")
    summed = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = cut(classes.select("label", "key", "rep", "copies").join(summed, "rep", "left")
                .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
                .select(F.col("label").alias("l"), F.col("key").alias("k"),
                        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"),
                        F.coalesce("component", "rep").alias("c")), "named")
    out = rows.select("id", "label", "key").join(named, (F.col("key") == F.col("k")) & (F.col("label") == F.col("l")), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("c", "id").alias("component_id"),
                      F.coalesce(F.col("id") == F.coalesce("c", "id"), F.lit(False)).alias("kept"))
