"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks.

Sources get targets that share all tokens by weight; a target stops at
``MOST_TIMES`` the source's size and the excess is shared again by weight. The
mix is ``tokens / BLOCK`` blocks. They go to sources by highest quotients
target / (2k - 1), and each source's blocks to its shards (documents by a seeded
hash, about ``SHARD_WORDS`` words each) by highest quotients shard size / (2k - 1),
which gives every shard an integer quota. In a shard, documents stand in the
order of another seeded hash; whole rounds of the shard and then the leading
blocks of one more round fill the quota.

Highest quotients without a loop: with n cells and Q seats, dividing by
V / (Q - n/2) gives Q seats at most, by V / (Q + n/2) Q at least, and the two differ
by 2n seats or so. Only those seats' quotients are ranked.

Sizes are summed by source and by shard before anything is ranked: ranking
sees one row per source or shard, and cumulative sums run within a shard, so a
source with a third of all rows is spread over its shards.

Defined cases: NULL and empty texts have size 0 and nothing is taken of them; NULL
sources are one source, ordered last; rows that share id and source are ordered by
size; a table without words takes nothing; an empty table gives an empty result;
names of other columns cannot clash (``mixed_rows`` packs the row); texts are
counted, and mixed, whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.flat import add_columns, flat_utf8, fresh, words_per_text
from gleaner.llm.lineage import cut

BLOCK = 32
SHARD_WORDS = 1 << 20
SHARD_DOCS = 1 << 15
MOST_TIMES = 3
WEIGHTS = 3
SEED = 11


def with_sizes(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` and each text's number of words ``[^\\x20\\x09-\\x0D]+``."""
    return add_columns(docs, text_col, f"`{name}` long",
                       lambda texts: [pa.array(words_per_text(*flat_utf8(texts)))])


def targets(sources: DataFrame) -> DataFrame:
    """``sources`` (source, size, docs) and weight, target: shares of all tokens, MOST_TIMES the size at most.

    One level L solves sum(least(MOST_TIMES * size, L * weight)) = tokens; it only rises, and a step that
    leaves it where it is has found it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    weighed = cut(sources.withColumn("weight", (F.row_number().over(order) - 1) % WEIGHTS + 1), "sources")
    most = F.col("size") * MOST_TIMES
    tokens = weighed.agg(F.sum("size")).first()[0] or 0
    level, last = 0.0, -1.0
    while tokens and level != last:
        full = F.lit(level) * F.col("weight") > most
        held, free = weighed.agg(F.sum(F.when(full, most).otherwise(0)),
                                 F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        level, last = ((tokens - held) / free if free else level), level
    return weighed.withColumn("target", F.when(F.lit(level) * F.col("weight") > most, most.cast("double"))
                              .otherwise(F.lit(float(level)) * F.col("weight")))


def sainte_lague(cells: DataFrame, groups: list[str], votes: str, seats: str, order: list) -> DataFrame:
    """``cells`` and ``won``: each group's ``seats`` (the same in all its rows) by highest quotients of ``votes``.

    Equal quotients go by ``order``. Cells without votes get nothing.
    """
    within = Window.partitionBy(*groups)
    v, q = F.col(votes), F.col(seats)
    bounds = (cells.withColumn("_votes", F.sum(v.cast("double")).over(within))
              .withColumn("_half", F.sum(F.when(v > 0, 1).otherwise(0)).over(within) / 2 + 1))
    won = lambda q: F.floor(v * q / F.col("_votes") + 0.5)
    bounds = (bounds.withColumn("_sure", F.when(v > 0, won(F.greatest(q - F.col("_half"), F.lit(0.0)))).otherwise(0))
              .withColumn("_may", F.when((v > 0) & (q > 0), won(q + F.col("_half"))).otherwise(0))
              .withColumn("_rest", q - F.sum("_sure").over(within)))
    # The seat that a cell is sure of is one row too (quotient NULL), so that no cell is lost.
    tried = bounds.select("*", F.explode(F.sequence(F.col("_sure"), F.greatest("_sure", "_may"))).alias("_k"))
    ranked = tried.withColumn("_quotient", F.when(F.col("_k") > F.col("_sure"), v / (2 * F.col("_k") - 1)))
    rank = F.row_number().over(within.orderBy(F.col("_quotient").desc_nulls_last(), *order))
    ranked = ranked.withColumn("_won", (F.col("_quotient").isNotNull() & (rank <= F.col("_rest"))).cast("long"))
    keep = [F.col(c) for c in cells.columns]
    return (ranked.groupBy(*keep, "_sure").agg(F.sum("_won").alias("_more"))
            .select(*keep, (F.col("_sure") + F.col("_more")).alias("won")))


def _hash(what: str, key: F.Column) -> F.Column:
    return F.md5(F.concat(F.lit(f"{what}{SEED}:"), F.coalesce(key.cast("string"), F.lit("-"))))


def quotas(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``rows`` (id, source, size): sources with target and number of shards; shards with their quota in words."""
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")))
    sources = sources.withColumn("shards", F.greatest(
        F.ceil(F.col("size") / SHARD_WORDS), F.ceil(F.col("docs") / SHARD_DOCS)).cast("long"))
    blocks = sources.withColumn("seats", F.round(F.sum("size").over(Window.partitionBy()) / BLOCK).cast("long"))
    sources = cut(sainte_lague(blocks, [], "target", "seats", [F.col("source").asc_nulls_last()]), "targets")
    few = sources.select(F.col("source").alias("of"), "shards", F.col("won").alias("seats"))
    cells = (rows.join(few, F.col("source").eqNullSafe(F.col("of")))
             .withColumn("shard", shard_of(F.col("id"), F.col("shards")))
             .groupBy("source", "shard", "seats").agg(F.sum("size").alias("held")))
    cells = sainte_lague(cells, ["source"], "held", "seats", [F.col("shard")])
    return sources, cut(cells.select("source", "shard", "held", F.least(
        F.col("won") * BLOCK, F.col("held") * MOST_TIMES).alias("quota")), "shards")


def shard_of(key: F.Column, shards: F.Column) -> F.Column:
    return F.conv(F.substring(_hash("shard", key), 1, 8), 16, 10).cast("long") % shards


def take(rows: DataFrame, sources: DataFrame, shards: DataFrame) -> DataFrame:
    """``rows`` (id, source, size and more) and source_size, target, taken."""
    few = sources.select(F.col("source").alias("of"), F.col("size").alias("source_size"), "target", "shards")
    cells = shards.select(F.col("source").alias("in"), F.col("shard").alias("no"), "held", "quota")
    placed = (rows.join(few, F.col("source").eqNullSafe(F.col("of"))).drop("of")
              .withColumn("shard", shard_of(F.col("id"), F.col("shards"))))
    placed = placed.join(cells, F.col("source").eqNullSafe(F.col("in")) & (F.col("shard") == F.col("no")))
    seeded = (Window.partitionBy("source", "shard").orderBy(_hash("order", F.col("id")), "id", "size")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.sum("size").over(seeded) - F.col("size")
    rounds = F.when(F.col("held") > 0, F.floor(F.col("quota") / F.col("held"))).otherwise(0)
    rest = F.col("quota") - rounds * F.col("held")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return placed.withColumn("taken", taken.cast("long")).drop(
        "of", "in", "no", "held", "quota", "shard", "shards")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken) of every document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    rows = cut(with_sizes(rows, "size").drop("text"), "sizes")
    return take(rows, *quotas(rows)).select(
        F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source") -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as it is taken, always whole.

    The document at the seam of a shard's quota, of which a part is taken, comes once more if that part is half of it
    or more; so a shard is off its quota by half a document at most, and no document comes more than MOST_TIMES.
    """
    size = fresh(docs, "_size")
    sized = with_sizes(docs, size, text_col)
    rows = sized.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"),
                        F.col(size).alias("size"))
    plan = quotas(cut(rows, "sizes"))
    packed = sized.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"),
                          F.col(size).alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    taken = take(packed, *plan).where("taken > 0")
    times = F.round(F.col("taken") / F.col("size")).cast("int")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")
