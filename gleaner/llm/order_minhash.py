"""Near-duplicate documents by Order MinHash and banded alignment.

**Texts.** Words are runs of letters, digits and underscores, lower-cased; a
shingle is ``SHINGLE`` consecutive words (a shorter text is one shingle). Texts
with equal words are one class at once, by a 128-bit hash of the words; all that
follows sees one row per class.

**Sketch.** Shingles are labelled with their occurrence number, so repeats
count. For each of ``TABLES`` hash functions, the ``MINIMA`` least labelled
shingles, kept in text order, make one key: equal keys need equal shingles in
equal order, so they are likelier the greater the edit similarity. A
similarity of 0.8 shares a key in one table with about 0.8 ** 3, and misses all 20
tables once in a million.

**Candidates.** Classes with an equal key are compared in blocks of bounded size
by the ``CHECKS`` bytes of a MinHash signature, which is wide enough that a pair
at the threshold is missed about once in a hundred thousand. A pair counts in
the first table where its keys are equal. A block hands on its documents that
have a likely partner there, not the pairs.

**Large buckets.** Comparing all chunks of a bucket with each other would ship each
of its documents once for every chunk. So a bucket of more than ``BLOCK`` documents
is seeded first: each chunk is compared by itself and with the same few pivots,
which ships a document once. In a large group of near copies that joins nearly
all. Then only documents of different groups still need comparing: a bucket whose
documents are one group is done, and of any other the documents outside its
largest group are compared with each other and with that group. Every pair of
different groups meets, so the result is that of comparing all pairs.

**Verification.** Those documents' texts meet again in their blocks. Shared
shingles of all pairs of a block are counted exactly (a matrix product over the
shingles that occur twice or more), which leaves the pairs that can reach
``SIMILARITY``; from the closest on, each that joins two groups of the block is
aligned: the longest common subsequence of the two sequences of shingles,
bit-parallel, within the band that the similarity leaves. common / (n + m -
common) >= 0.8 allows (n + m) / 9 insertions and deletions. A block gives the
links of a spanning forest, so a large group of near copies costs about as many
links as it has documents, and no link between groups is left out. Components
are found distributed; a document's class is the least id.

Defined cases: NULL texts and texts without words are near nothing (their own
class); rows that share an id are one node, compared by the least of their
texts; rows without an id are near nothing and have no class; an empty table gives an
empty result; only the id and text columns are read, so other columns cannot
clash. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.blocks import by_block, whole_groups
from gleaner.llm.components import components
from gleaner.llm.flat import slices
from gleaner.llm.lineage import cut, ids_to_join

SHINGLE = 5
SIMILARITY = 0.8
TABLES, MINIMA, CHECKS = 20, 3, 256
SIGNATURE = CHECKS + 8 * TABLES
#: Share of equal signature bytes that makes a candidate: 4.5 standard deviations below 0.8.
LIKELY = SIMILARITY - 4.5 * (SIMILARITY * (1 - SIMILARITY) / CHECKS) ** 0.5
BLOCK = 1024
COLUMNS = 4096
BLOCK_KEYS = ["t", "key", "low", "high"]
#: Tables whose large buckets are seeded, and pivots of a bucket (on average).
SEED_TABLES, PIVOTS = 2, 8
CHUNK = 1 << 14
CACHE_WORDS = 200_000

WORD = re.compile(r"\w+")
_rng = np.random.default_rng(5)
MULTIPLY = (_rng.integers(1, 1 << 32, CHECKS, dtype=np.uint32) | np.uint32(1))[:, None]
FLIP = _rng.integers(0, 1 << 32, CHECKS, dtype=np.uint32)[:, None]
GOLDEN = np.uint32(0x9E3779B1)
ODD = [np.uint64(int(x) | 1) for x in _rng.integers(1 << 62, 1 << 63, SHINGLE + 2, dtype=np.uint64)]

_words: dict[str, int] = {}


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a multiply-xorshift finaliser)."""
    x = (x ^ (x >> np.uint64(32))) * ODD[0]
    x = (x ^ (x >> np.uint64(29))) * ODD[1]
    return x ^ (x >> np.uint64(32))


def shingles(words: list[str]) -> np.ndarray:
    """64-bit hashes of the text's shingles in order."""
    import xxhash

    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(_words) > CACHE_WORDS:
        _words.clear()
    get, hashed = _words.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = _words[w] = xxhash.xxh3_64_intdigest(w)
        hashed.append(h)
    h = np.array(hashed, dtype=np.uint64)
    n = max(1, len(h) - SHINGLE + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out = out * ODD[2] + h[k:k + n] * ODD[2 + k]
    return _mix(out)


def labelled(grams: np.ndarray) -> np.ndarray:
    """Hashes of (shingle, occurrence number)."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    if new.all():
        return grams
    at = np.arange(len(grams))
    occurrence = np.empty(len(grams), dtype=np.uint64)
    occurrence[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return np.where(occurrence == 0, grams, _mix(grams + occurrence * ODD[6]))


def sketch(grams: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Keys of all tables, and the signature (CHECKS bytes of minima, then the keys), of a text with a shingle."""
    marks = labelled(grams)
    small = (marks >> np.uint64(32)).astype(np.uint32)
    least = np.full(CHECKS, np.iinfo(np.uint32).max, dtype=np.uint32)
    value = np.zeros((TABLES, 0), dtype=np.uint32)
    place = np.zeros((TABLES, 0), dtype=np.int64)
    for a in range(0, len(small), CHUNK):
        h = (small[None, a:a + CHUNK] ^ FLIP) * MULTIPLY
        np.minimum(least, h.min(axis=1), out=least)
        value = np.concatenate([value, h[:TABLES]], axis=1)
        place = np.concatenate([place, np.broadcast_to(np.arange(a, a + h.shape[1]), (TABLES, h.shape[1]))], axis=1)
        if value.shape[1] > MINIMA:
            best = np.argpartition(value, MINIMA - 1, axis=1)[:, :MINIMA]
            value, place = np.take_along_axis(value, best, 1), np.take_along_axis(place, best, 1)
    chosen = marks[np.sort(place, axis=1)]
    key = np.zeros(TABLES, dtype=np.uint64)
    for k in range(chosen.shape[1]):
        key = _mix(key + chosen[:, k] * ODD[3 + k % 3])
    return key.view(np.int64), ((least * GOLDEN) >> np.uint32(24)).astype(np.uint8).tobytes() + key.tobytes()


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, words_key, n, keys, signature) of every row; the last four NULL for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                if not words:
                    rows.append((None, None, None, None))
                    continue
                grams = shingles(words)
                rows.append((xxhash.xxh3_128_digest(" ".join(words)), len(grams), *sketch(grams)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([r[0] for r in rows], pa.binary()),
                 pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                 pa.array([r[3] for r in rows], pa.binary())], names=["id", "words_key", "n", "keys", "signature"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, words_key binary, n long, keys array<long>, signature binary")


def likely_members(members: DataFrame) -> DataFrame:
    """The rows of ``members`` (block, rep, group) that have a likely partner of another group in their block's table
    first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, BLOCK_KEYS):
            n, chunk, t, group = (table.column(c).to_numpy() for c in ("n", "chunk", "t", "group"))
            cross = table.column("low").to_numpy() != table.column("high").to_numpy()
            marks = _fixed(table.column("signature"), CHECKS)
            keys = _fixed(table.column("signature"), CHECKS, 8 * TABLES).view(np.int64)
            has = np.zeros(len(n), dtype=bool)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                for i in range(lo, hi - 1):
                    may = np.minimum(n[i + 1:hi], n[i]) >= SIMILARITY * np.maximum(n[i + 1:hi], n[i])
                    may &= group[i + 1:hi] != group[i]
                    if cross[lo]:
                        may &= chunk[i + 1:hi] != chunk[i]
                    at = np.flatnonzero(may) + i + 1
                    at = at[np.count_nonzero(marks[at] == marks[i], axis=1) >= LIKELY * CHECKS]
                    if len(at) and t[lo]:
                        at = at[~(keys[at, :t[lo]] == keys[i, :t[lo]]).any(axis=1)]
                    if len(at):
                        has[i] = has[at] = True
            yield from table.select([*BLOCK_KEYS, "chunk", "rep", "group"]).filter(pa.array(has)).to_batches()

    return members.mapInArrow(run, "t int, key long, low int, high int, chunk int, rep long, group long")


def _fixed(column: pa.ChunkedArray, skip: int, width: int | None = None) -> np.ndarray:
    """Bytes of a binary column of SIGNATURE bytes a row: the first ``skip``, or ``width`` from there."""
    array = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if not len(array):
        return np.zeros((0, width or skip), dtype=np.uint8)
    first = np.frombuffer(array.buffers()[1], dtype=np.int32, count=1, offset=4 * array.offset)[0]
    rows = np.frombuffer(array.buffers()[2], dtype=np.uint8)[first:first + SIGNATURE * len(array)].reshape(-1, SIGNATURE)
    return np.ascontiguousarray(rows[:, skip:skip + width] if width else rows[:, :skip])


def links(members: DataFrame) -> DataFrame:
    """(a, b): verified links that join the groups of each block of ``members`` (block, rep, group, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, BLOCK_KEYS):
            rep, chunk = table.column("rep").to_pylist(), table.column("chunk").to_numpy()
            group = table.column("group").to_numpy()
            low, high, text = table.column("low").to_numpy(), table.column("high").to_numpy(), table.column("text")
            out = []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                grams = [shingles(words_of(x)) for x in text.slice(lo, hi - lo).to_pylist()]
                apart = chunk[lo:hi] if low[lo] != high[lo] else None
                out.extend((rep[lo + i], rep[lo + j]) for i, j in spanning(grams, apart, group[lo:hi]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)],
                                             names=["a", "b"])

    return members.mapInArrow(run, "a long, b long")


def shared_counts(marks: list[np.ndarray]) -> np.ndarray:
    """How many labelled shingles each two texts share."""
    owner = np.repeat(np.arange(len(marks)), [len(m) for m in marks])
    _, gram, times = np.unique(np.concatenate(marks), return_inverse=True, return_counts=True)
    keep = times[gram] > 1
    number = np.cumsum(times > 1) - 1
    owner, gram = owner[keep], number[gram[keep]]
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    total = np.zeros((len(marks), len(marks)), dtype=np.float32)
    for a in range(0, int(gram[-1]) + 1 if len(gram) else 0, COLUMNS):
        lo, hi = np.searchsorted(gram, [a, a + COLUMNS])
        part = np.zeros((len(marks), COLUMNS), dtype=np.float32)
        part[owner[lo:hi], gram[lo:hi] - a] = 1
        total += part @ part.T
    return total


def needed(n, m):
    """The least number of common shingles that reaches the similarity."""
    return np.ceil(SIMILARITY * (n + m) / (1 + SIMILARITY) - 1e-9)


def spanning(grams: list[np.ndarray], chunk: np.ndarray | None = None,
             group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Verified pairs that span the groups of similar texts; with ``chunk``, only pairs of different chunks.

    Texts of one ``group`` are joined from the start.
    """
    size = np.array([len(g) for g in grams], dtype=np.float64)
    shared = shared_counts([labelled(g) for g in grams])
    may = np.triu(shared >= needed(size[:, None], size[None, :]), 1)
    if chunk is not None:
        may &= chunk[:, None] != chunk[None, :]
    parent = list(range(len(grams)))
    if group is not None:
        may &= group[:, None] != group[None, :]
        _, first, number = np.unique(group, return_index=True, return_inverse=True)
        parent = first[number].tolist()
    i, j = np.nonzero(may)
    order = np.lexsort((j, i, -shared[i, j] / (size[i] + size[j])))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for x, y in zip(i[order].tolist(), j[order].tolist()):
        a, b = root(x), root(y)
        if a != b and similar(grams[x], grams[y]):
            parent[a] = b
            out.append((x, y))
    return out


def common_in_band(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence with places at most ``band`` apart (bit-parallel by rows)."""
    where: dict[int, int] = {}
    for i, g in enumerate(a.tolist()):
        where[g] = where.get(g, 0) | (1 << i)
    full = (1 << len(a)) - 1
    window, row = (1 << (2 * band + 1)) - 1, full
    for j, g in enumerate(b.tolist()):
        hit = where.get(g)
        if hit is None:
            continue
        hit &= window << (j - band) if j >= band else window >> (band - j)
        if hit:
            u = row & hit
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the aligned shingles of two texts reach the similarity."""
    n, m = len(a), len(b)
    enough = int(needed(n, m))
    return min(n, m) >= enough and common_in_band(a, b, n + m - 2 * enough) >= enough


def seed_blocks(keyed: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rows of large buckets in chunks, each with the bucket's pivots: once a row, and once a chunk for a pivot."""
    large = buckets.where((F.col("size") > BLOCK) & (F.col("t") < SEED_TABLES))
    rows = keyed.join(large, ["t", "key"]).withColumn("chunks", F.ceil(F.col("size") / BLOCK).cast("int"))
    pivot = F.pmod(F.xxhash64("rep", F.lit("pivot")), F.col("size")) < PIVOTS
    own = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    at = F.when(pivot, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own))
    return (rows.withColumn("low", F.explode(at)).withColumn("high", F.col("low")).withColumn("chunk", F.lit(0))
            .withColumn("group", F.col("rep")).drop("size", "chunks"))


def group_blocks(keyed: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rows of ``keyed`` (rep, group, t, key) in blocks in which every two of different groups of a bucket meet."""
    shared = cut(keyed.join(buckets, ["t", "key"]), "shared")
    parts = shared.groupBy("t", "key", "group").agg(F.count(F.lit(1)).alias("part"))
    open_ = parts.groupBy("t", "key").agg(F.count(F.lit(1)).alias("groups"), F.max("part").alias("most"),
                                          F.max_by("group", F.struct("part", "group")).alias("main"))
    # One row a bucket with several groups.
    open_ = cut(open_.where("groups > 1").drop("groups"), "open")
    rows = shared.join(open_, ["t", "key"])
    small = rows.where(F.col("size") <= BLOCK).withColumns(
        {"chunk": F.lit(0), "low": F.lit(0), "high": F.lit(0)})
    large = rows.where(F.col("size") > BLOCK).withColumn("rest", F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int"))
    large = large.withColumn("mains", F.ceil(F.col("most") / BLOCK).cast("int"))
    in_main = F.col("group") == F.col("main")
    own = F.when(in_main, F.col("rest") + F.pmod(F.xxhash64("rep"), F.col("mains"))).otherwise(
        F.pmod(F.xxhash64("rep"), F.col("rest"))).cast("int")
    others = F.sequence(F.lit(0), F.when(in_main, F.col("rest")).otherwise(F.col("rest") + F.col("mains")) - 1)
    large = large.withColumn("chunk", own).withColumn("other", F.explode(others))
    large = large.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))
    names = ["rep", "group", *BLOCK_KEYS, "chunk"]
    return small.select(*names).unionByName(large.select(*names))


def verified(blocks: DataFrame, equal: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b): links that join groups of the blocks' rows; signatures first, then texts of those with a likely partner."""
    members = cut(blocks, "blocks").join(equal.select("rep", "n", "signature"), "rep")
    likely = cut(likely_members(by_block(members, BLOCK_KEYS)), "likely")
    texts = cut(docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
                .join(ids_to_join(likely.select("rep").distinct()), "rep").groupBy("rep").agg(F.min("text").alias("text")), "texts")
    return cut(links(by_block(likely.join(texts, "rep"), BLOCK_KEYS)), "links")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id) of every row: the least id of its near-duplicate group."""
    rows = cut(sketches(docs, id_col, text_col), "sketches")
    equal = rows.where("words_key IS NOT NULL AND id IS NOT NULL").groupBy("words_key").agg(
        F.min("id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"),
        F.first("signature").alias("signature"))
    equal = cut(equal, "classes")
    # Buckets are found on ids and keys alone; only rows of shared buckets get their signature.
    keyed = equal.select("rep", F.posexplode("keys").alias("t", "key"))
    buckets = cut(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    edges = docs.sparkSession.createDataFrame([], "a long, b long")
    grouped = keyed.withColumn("group", F.col("rep"))
    if buckets.where((F.col("size") > BLOCK) & (F.col("t") < SEED_TABLES)).limit(1).count():
        seeded = cut(components(verified(seed_blocks(keyed, buckets), equal, docs, id_col, text_col)), "seeded")
        edges = seeded.select(F.col("node").alias("a"), F.col("component").alias("b"))
        grouped = keyed.join(seeded, F.col("rep") == F.col("node"), "left").select(
            "rep", F.coalesce("component", "rep").alias("group"), "t", "key")
    found = components(edges.unionByName(verified(group_blocks(grouped, buckets), equal, docs, id_col, text_col)))
    named = equal.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("words_key").alias("k"), F.coalesce("component", "rep").alias("class"))
    return rows.join(cut(named, "named"), F.col("words_key") == F.col("k"), "left").select(
        F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.coalesce("class", "id")).alias("class_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their class: one document of each group, with its columns.

    Rows that share the kept id become one; rows without an id stay.
    """
    named = classes(docs, id_col, text_col)
    gone = ids_to_join(named.where(F.col("class_id") != F.col(id_col)).select(F.col(id_col).cast("long").alias("_gone"))
                       .distinct(), "gone")
    packed = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"),
                         F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    left = packed.join(gone, F.col("_id") == F.col("_gone"), "left_anti")
    again = ids_to_join(left.where("_id IS NOT NULL").groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
                        .select(F.col("_id").alias("_twice")), "twice")
    marked = left.join(again, F.col("_id") == F.col("_twice"), "left")
    once = marked.where("_twice IS NULL").select("_row.*")
    return once.unionByName(marked.where("_twice IS NOT NULL").groupBy("_id").agg(F.min("_row").alias("_row"))
                            .select("_row.*"))
