"""Merkle manifest of a table: nested-interval labels, proofs by containment and interval difference.

**Leaves.** A row's leaf is the SHA-256 of its fields, each with its length, so
no two rows write the same bytes. Leaves and changed leaves are made by Spark's
own functions; only hashes are shuffled.

**Labels.** Leaves are ranked within their tree (a source; the sources' roots
form a tree of their own) by a range partitioning and one count a partition and
tree. A node of level ``L`` covers the leaf ranks ``[lo, hi)``, where ``lo`` is a
multiple of ``FAN ** L``; a node contains another if its interval does.

**Building.** Levels are bucketed: ``DEPTH`` levels at once are computed in blocks
of ``FAN ** DEPTH`` leaves, whose roots are the leaves of the next bucket, until
every tree has one node. No task sees more than a block of a tree, so a tree with
a third of all leaves is spread like any other.

**Proofs.** Within a bucket of levels, a leaf's ancestors are the nodes that
contain its rank; its siblings are the parent's children less its own interval.
From the last bucket down, each block's root brings the proof above it to its
block (a containment join on tree and block), as one row a block. A step of a
proof is what stands before and after the node in the parent's run, so a proof
can be folded with another leaf in its place.

Defined cases: NULL fields are written as a mark of their own, so they differ
from empty texts; rows of one id are ordered by leaf, rows without id come
first; repeated rows are leaves of their own; a NULL source is a tree, the first;
an empty table gives an empty result. The fields of a leaf are named by the
caller; other columns are not read, so none can clash. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gleaner.llm.blocks import whole_groups
from gleaner.llm.lineage import cut

FAN = 3
#: Levels computed in one block.
DEPTH = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

ORACLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, text, sha256(concat({", ".join(
      f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', {c}) END" for c in FIELDS)})) AS leaf,
    sha256(concat({", ".join(
      f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({v} AS VARCHAR)), ':', {v}) END"
      for c, v in ((c, "replace(text, chr(10), '')" if c == "text" else c) for c in FIELDS))})) AS altered
  FROM documents),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS leaf_rank,
    count(*) OVER (PARTITION BY source) AS leaves
  FROM leaves),
nodes(source, level, place, hash, held) AS (
  SELECT source, 0, leaf_rank, leaf, leaves FROM ranked
  UNION ALL
  SELECT source, level + 1, place // {FAN}, sha256(string_agg(hash, '' ORDER BY place)),
    (held + {FAN - 1}) // {FAN} FROM nodes WHERE held > 1 GROUP BY source, level, place // {FAN}, held),
subroots AS (
  SELECT source, hash, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS held
  FROM nodes WHERE held = 1),
top(level, place, hash, held) AS (
  SELECT 0, place, hash, held FROM subroots
  UNION ALL
  SELECT level + 1, place // {FAN}, sha256(string_agg(hash, '' ORDER BY place)),
    (held + {FAN - 1}) // {FAN} FROM top WHERE held > 1 GROUP BY level, place // {FAN}, held),
bits(b, crc) AS (  -- CRC-32 of the decimal id, bit by bit
  SELECT doc_id, 4294967295::BIGINT FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
crcs(doc_id, rest, crc) AS (
  SELECT b, CAST(b AS VARCHAR), crc FROM bits
  UNION ALL
  SELECT doc_id, substr(rest, 2), list_reduce([xor(crc, ascii(rest)::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) FROM crcs WHERE rest <> ''),
even AS (SELECT doc_id FROM crcs WHERE rest = '' AND xor(crc, 4294967295) % 2 = 0),
steps AS (  -- what stands before and after the path's node in each run, from the leaf up
  SELECT r.source, r.leaf_rank, p.level,
    string_agg(s.hash, '' ORDER BY s.place) FILTER (s.place < p.place) AS before,
    string_agg(s.hash, '' ORDER BY s.place) FILTER (s.place > p.place) AS after
  FROM ranked r JOIN nodes p ON r.source IS NOT DISTINCT FROM p.source AND p.held > 1
      AND p.place = r.leaf_rank // CAST(power({FAN}, p.level) AS BIGINT)
    JOIN nodes s ON s.source IS NOT DISTINCT FROM p.source AND s.level = p.level AND s.place // {FAN} = p.place // {FAN}
  GROUP BY ALL
  UNION ALL
  SELECT r.source, r.leaf_rank, 1000 + p.level,
    string_agg(s.hash, '' ORDER BY s.place) FILTER (s.place < p.place),
    string_agg(s.hash, '' ORDER BY s.place) FILTER (s.place > p.place)
  FROM ranked r JOIN subroots u ON r.source IS NOT DISTINCT FROM u.source
    JOIN top p ON p.held > 1 AND p.place = u.place // CAST(power({FAN}, p.level) AS BIGINT)
    JOIN top s ON s.level = p.level AND s.place // {FAN} = p.place // {FAN}
  GROUP BY ALL),
numbered AS (
  SELECT source, leaf_rank, coalesce(before, '') AS before, coalesce(after, '') AS after,
    row_number() OVER (PARTITION BY source, leaf_rank ORDER BY level) AS nth FROM steps),
proofs AS (
  SELECT source, leaf_rank, sha256(string_agg(before || after, '' ORDER BY nth)) AS proof FROM numbered GROUP BY ALL),
folded(source, leaf_rank, nth, hash) AS (
  SELECT source, leaf_rank, 0::BIGINT, CASE WHEN doc_id IN (SELECT doc_id FROM even) THEN altered ELSE leaf END FROM ranked
  UNION ALL
  SELECT f.source, f.leaf_rank, f.nth + 1, sha256(n.before || f.hash || n.after)
  FROM folded f JOIN numbered n ON f.source IS NOT DISTINCT FROM n.source AND f.leaf_rank = n.leaf_rank
    AND n.nth = f.nth + 1),
ends AS (SELECT source, leaf_rank, arg_max(hash, nth) AS folded_root FROM folded GROUP BY ALL)
SELECT r.doc_id, r.leaf, u.hash AS subroot, t.hash AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
  e.folded_root, e.folded_root = t.hash AS verified
FROM ranked r JOIN subroots u ON r.source IS NOT DISTINCT FROM u.source
  JOIN (SELECT hash FROM top WHERE held = 1) t ON TRUE
  JOIN ends e ON r.source IS NOT DISTINCT FROM e.source AND r.leaf_rank = e.leaf_rank
  LEFT JOIN proofs p ON r.source IS NOT DISTINCT FROM p.source AND r.leaf_rank = p.leaf_rank
"""


def leaf_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields in order: ``-`` for NULL, else UTF-8 length, colon, value."""
    parts = []
    for value in fields.values():
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.encode(F.concat(*parts), "UTF-8"), 256)


def leaves(docs: DataFrame, tampered: Callable[[DataFrame], Column] | None = None, fields=FIELDS,
           id_col: str = "doc_id", tree_col: str = "source", text_col: str = "text") -> DataFrame:
    """(tree, id, hash, altered) of every row; ``altered`` is the leaf of the row with its tampered text."""
    own = {c: F.col(c) for c in fields}
    altered = leaf_hash(own | {text_col: tampered(docs)}) if tampered else leaf_hash(own)
    return docs.select(F.col(tree_col).alias("tree"), F.col(id_col).alias("id"), leaf_hash(own).alias("hash"),
                       altered.alias("altered"))


def ranked(rows: DataFrame, order: list[str], trees: bool = True) -> DataFrame:
    """``rows`` (tree, ...) with the tree's own rank (``key``), their rank in it by ``order``, and how many it holds.

    One range shuffle of the rows; a tree has one count in each partition that holds some of it. The trees are
    ranked in the same way (``trees``), as the rows of one tree.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column("tree")
            code = tree.dictionary_encode(null_encoding="encode").indices.to_numpy()
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            size = np.diff(np.append(first, len(code)))
            at = np.arange(len(code)) - np.repeat(first, size)
            if n and tree[0].as_py() == last:  # the tree goes on from the batch before
                at[:size[0]] += n
            last, n = tree[len(code) - 1].as_py(), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(code), part, dtype=np.int32)), pa.array(at)],
                names=[*names, "part", "at"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = cut(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
                 .mapInArrow(run, f"{kinds}, part int, at long"), "placed")
    counts = placed.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    whole, earlier = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("part")  # a row a partition
    offsets = cut(counts.select("tree", "part", F.sum("n").over(whole).alias("held"),
                                (F.sum("n").over(earlier) - F.col("n")).alias("before")), "offsets")
    if trees:
        named = offsets.select(F.lit(0).alias("tree"), F.col("tree").alias("name")).distinct()
        named = ranked(named, ["name"], trees=False).select("name", F.col("rank").alias("key"))
        offsets = offsets.join(named, F.col("tree").eqNullSafe(F.col("name"))).drop("name")
    else:
        offsets = offsets.withColumn("key", F.lit(0).cast("long"))
    same = [F.col("p.part") == F.col("o.part"), F.col("p.tree").eqNullSafe(F.col("o.tree"))]
    return placed.alias("p").join(offsets.alias("o"), same).select(
        *(F.col(f"p.{c}") for c in names), "key", (F.col("before") + F.col("at")).alias("rank"), "held")


# Nodes --------------------------------------------------------------------------------------


def block_levels(hashes: list[str], held: int) -> list[list[str]]:
    """Hashes of a block's nodes, level by level from its leaves, in a tree of ``held`` leaves.

    A block that is its whole tree ends with the only node; any other has ``DEPTH`` levels above its leaves.
    """
    levels = [hashes]
    while len(levels[-1]) > 1 if held <= FAN ** DEPTH else len(levels) <= DEPTH:
        below = levels[-1]
        levels.append([hashlib.sha256("".join(below[k:k + FAN]).encode()).hexdigest()
                       for k in range(0, len(below), FAN)])
    return levels


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Each block's rows, by rank."""
    for table, bounds in whole_groups(batches, ["key", "block"]):
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield table.slice(a, b - a)


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "rank")


def _blocked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", F.expr(f"rank div {FAN ** DEPTH}"))


NODE = "key long, block long, level int, lo long, hi long, hash string, held long"


def block_nodes(below: DataFrame) -> DataFrame:
    """Every node that one bucket of levels adds above ``below`` (key, rank, hash, held), with its interval.

    ``level`` and the interval count in nodes of ``below``. ``held`` is 0 but for the block's root, where it is the
    number of such roots in the tree.
    """
    size = FAN ** DEPTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _blocks(batches):
            key, block, held = (group.column(c)[0].as_py() for c in ("key", "block", "held"))
            levels = block_levels(group.column("hash").to_pylist(), held)
            out = []
            for level, hashes in enumerate(levels):
                top = level == len(levels) - 1
                if level or top:
                    step = FAN ** level
                    out += [(key, block, level, block * size + k * step,
                             min(block * size + (k + 1) * step, block * size + group.num_rows), h,
                             -(-held // size) if top else 0) for k, h in enumerate(hashes)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)],
                                             names=["key", "block", "level", "lo", "hi", "hash", "held"]).cast(
                pa.schema([("key", pa.int64()), ("block", pa.int64()), ("level", pa.int32()), ("lo", pa.int64()),
                           ("hi", pa.int64()), ("hash", pa.string()), ("held", pa.int64())]))

    return _by_block(_blocked(below.select("key", "rank", "hash", "held"))).mapInArrow(run, NODE)


def build(rows: DataFrame) -> list[DataFrame]:
    """The nodes of all trees, one table a bucket of levels, above ``rows`` (key, rank, hash, held).

    The roots of a table's blocks (``held`` > 0) are the leaves of the next; in the last each tree has one root.
    """
    out = [cut(block_nodes(rows), "nodes")]
    while out[-1].where("held > 1").limit(1).count():
        out.append(cut(block_nodes(roots(out[-1])), "nodes"))
    return out


def roots(nodes: DataFrame) -> DataFrame:
    """(key, rank, hash, held) of the blocks' roots."""
    return nodes.where("held > 0").select("key", F.col("block").alias("rank"), "hash", "held")


# Proofs -------------------------------------------------------------------------------------


def block_steps(level: np.ndarray, lo: np.ndarray, hi: np.ndarray, hashes: list[str],
                ranks: np.ndarray) -> list[list[tuple[str, str]]]:
    """(before, after) of each leaf's ancestors in a block, from the leaf up, by the nodes' intervals.

    At each level the node that contains the rank and its parent, the node above that contains it too; of the nodes
    of the level in the parent's interval, those left of the node's own come before it, the others after it.
    """
    steps: list[list[tuple[str, str]]] = [[] for _ in ranks]
    for k in range(int(level.max())):
        own, up = np.flatnonzero(level == k), np.flatnonzero(level == k + 1)
        node = own[np.searchsorted(lo[own], ranks, side="right") - 1]
        parent = up[np.searchsorted(lo[up], ranks, side="right") - 1]
        first = own[0] + np.searchsorted(lo[own], lo[parent])
        end = own[0] + np.searchsorted(lo[own], hi[parent])
        run: dict[int, tuple[str, str]] = {}  # leaves under one node share the step
        for i, (n, a, b) in enumerate(zip(node.tolist(), first.tolist(), end.tolist())):
            if n not in run:
                run[n] = ("".join(hashes[a:n]), "".join(hashes[n + 1:b]))
            steps[i].append(run[n])
    return steps


def fold(leaf: str, steps: list[tuple[str, str]]) -> str:
    """The root that a leaf and its steps give."""
    for before, after in steps:
        leaf = hashlib.sha256(f"{before}{leaf}{after}".encode()).hexdigest()
    return leaf


PATH = "key long, block long, before array<string>, after array<string>, subroot string, root string"
PROOF = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _paths(row: dict, steps: list[tuple[str, str]], head: dict) -> tuple:
    return (row["key"], row["rank"], [s[0] for s in steps], [s[1] for s in steps],
            head["subroot"] or row["hash"], head["root"])


def _proofs(row: dict, steps: list[tuple[str, str]], head: dict) -> tuple:
    folded = fold(row["altered"], steps)
    proof = hashlib.sha256("".join(s[0] + s[1] for s in steps).encode()).hexdigest()
    return row["id"], row["hash"], head["subroot"], head["root"], proof, folded, folded == head["root"]


def attach(below: DataFrame, nodes: DataFrame, above: DataFrame, emit: Callable, ddl: str) -> DataFrame:
    """``emit(row, steps to the root, head)`` of every row of ``below``, the leaves of one bucket of levels.

    ``above`` has one row for each block (key, block): the steps from the block's root on. Leaves, nodes and steps of
    a block meet in one task.
    """
    names = T.StructType.fromDDL(ddl).names
    kinds = to_arrow_schema(T.StructType.fromDDL(ddl))
    rows = _blocked(below).withColumns({"level": F.lit(0), "lo": F.col("rank"), "hi": F.col("rank") + 1})
    rows = rows.unionByName(nodes.where("level > 0").withColumn("rank", F.col("lo")).drop("held"),
                            allowMissingColumns=True)
    rows = rows.unionByName(above.withColumn("level", F.lit(-1)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _blocks(batches):
            heads, group = group.slice(0, 1).to_pylist(), group.slice(1).combine_chunks()
            level, lo, hi = (group.column(c).to_numpy() for c in ("level", "lo", "hi"))
            leaf = int(np.count_nonzero(level == 0))
            own = block_steps(level, lo, hi, group.column("hash").to_pylist(), lo[:leaf])
            upper = list(zip(heads[0]["before"], heads[0]["after"]))
            out = [emit(row, steps + upper, heads[0]) for row, steps in
                   zip(group.slice(0, leaf).drop_columns(["before", "after"]).to_pylist(), own)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], names=names)

    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "level", "lo").mapInArrow(run, ddl)


def all_steps(rows: DataFrame, built: list[DataFrame], above: DataFrame, emit: Callable, ddl: str) -> DataFrame:
    """``emit`` of every row of ``rows`` (the trees' leaves); ``above`` (key, block 0) leads on from each tree's root."""
    leaves_of = [rows, *(roots(b) for b in built[:-1])]
    for below, nodes in list(zip(leaves_of, built))[:0:-1]:
        above = cut(attach(below, nodes, above, _paths, PATH), "paths")
    return attach(leaves_of[0], built[0], above, emit, ddl)


def manifest(docs: DataFrame, tampered: Callable[[DataFrame], Column] | None = None, fields=FIELDS,
             id_col: str = "doc_id", tree_col: str = "source", text_col: str = "text") -> DataFrame:
    """Leaf, roots, digest of the proof and its check, of every row.

    ``tampered`` gives a text to fold in the row's place; ``verified`` says whether the fold still gives the root.
    """
    rows = cut(leaves(docs, tampered, fields, id_col, tree_col, text_col), "leaves")
    rows = cut(ranked(rows, ["id", "hash"]), "ranked").drop("tree")
    built = build(rows)
    subroots = roots(built[-1])
    trees = cut(subroots.select(F.lit(0).cast("long").alias("key"), F.col("key").alias("rank"), "hash")
                .withColumn("held", F.lit(subroots.count())), "subroots")
    over = build(trees)
    none = F.array().cast("array<string>")
    top = roots(over[-1]).select("key", F.lit(0).cast("long").alias("block"), none.alias("before"), none.alias("after"),
                                 F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"))
    # A tree's steps from its root on; its key is its rank among the trees, and it has one block at the top.
    above = cut(all_steps(trees, over, top, _paths, PATH).select(
        F.col("block").alias("key"), F.lit(0).cast("long").alias("block"), "before", "after", "subroot", "root"), "paths")
    kind = rows.schema["id"].dataType.simpleString()
    out = all_steps(rows, built, above, _proofs, f"id {kind}, {PROOF}")
    return out.withColumnRenamed("id", id_col)


def without_breaks(id_col: str = "doc_id", text_col: str = "text") -> Callable[[DataFrame], Column]:
    """Tampering that deletes line breaks where 2 divides the CRC-32 of the decimal id; NULL ids have none."""
    even = F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 2 == 0, F.lit(False))
    return lambda docs: F.when(even, F.translate(text_col, "\n", "")).otherwise(F.col(text_col))
