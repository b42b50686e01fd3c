"""Token ids in ORC: range-partitioned files with row indexes and Bloom filters on the document id.

Texts are range-partitioned by document id, encoded, and written in ascending
id order, one file (or more) per range. ``ids`` is an ``array<int>``, which ORC
stores with integer run-length encoding; ``doc_id`` has row indexes and a Bloom
filter, so a reader of some ids skips stripes and row groups by metadata, and
stripes can be read in parallel. Each row also holds its range (``block``) and
the ids before it in that range (``block_start``); with the ranges' totals (one
row per range) a reader gets every document's place in the whole sequence
without sorting again.

Encoding: the tokenizer drops white space and never joins across it, nor across
the end of a run of letters, and it takes capitals for small letters. So a text
is cut there into words, and each distinct word of a batch is encoded once by
the library; the texts' ids are gathered from those.

Defined cases: NULL and empty texts hold the end id only; rows that share an id
are ordered by text (NULL first), NULL ids come first; an empty table gives an
empty table; only the id and text columns are read, so other columns cannot
clash. Texts are encoded whole.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner.llm.flat import slices

CACHE_WORDS = 800_000
SLICE_BYTES = 4 << 20
#: Runs of letters that are encoded as one text.
STEMS = 64
#: A Latin-1 letter and the ASCII marks behind it, up to white space: two tokens or more, cut between the two.
LETTER_MARKS = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([!-/:-@\[-`{-~]+)([ \t-\r]|$)"
#: Combining marks of Latin letters: what they make of a letter can depend on its case.
COMBINING = r"[\x{300}-\x{36F}]"
#: The beginning of a special token, in which nothing may be changed.
SPECIAL = "<|"

ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "10000",
    "orc.stripe.size": str(64 << 20),
    "compression": "zstd",
}


def words_of(texts: pa.Array) -> pa.ListArray:
    """The parts of each text that are encoded by themselves: those between ASCII white space, without the
    marks at their end, in small letters. NULL is the empty text."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if not pc.any(pc.match_substring(texts, SPECIAL)).as_py():
        if not pc.any(pc.match_substring_regex(texts, COMBINING)).as_py():
            texts = pc.ascii_lower(texts)
        texts = pc.replace_substring_regex(texts, LETTER_MARKS, r"\1 \2\3")
    return pc.ascii_split_whitespace(texts)


class WordEncoder:
    """Encodes texts by their distinct words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {"": b""}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, ``end_id`` behind each, and the n + 1 bounds of the texts."""
        split = words_of(texts)
        word = split.flatten().dictionary_encode()
        held = self._ids_of(word.dictionary.to_pylist())
        held.append(np.array([end_id], dtype="<i4").tobytes())
        length = np.array([len(h) for h in held], dtype=np.int32) // 4
        ids = np.frombuffer(b"".join(held), dtype="<i4")
        words = split.offsets.to_numpy() - split.offsets[0].as_py()
        which = np.insert(word.indices.to_numpy(), words[1:], len(held) - 1)  # the end id is each text's last word
        first, n = (np.cumsum(length, dtype=np.int32) - length)[which], length[which]
        ends = np.cumsum(n, dtype=np.int32)
        # Place k of a word that begins at ``a`` in the output takes ids[first + k - a].
        flat = ids[np.arange(len(which) and ends[-1], dtype=np.int32) + np.repeat(first - (ends - n), n)]
        return flat, np.append(0, ends)[words + np.arange(len(words))].astype(np.int64)

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of each word as bytes of 32-bit integers."""
        held = list(map(self.cache.get, words))
        new = [w for w, ids in zip(words, held) if ids is None]
        if new:
            stems = [w for w in new if w.isalpha() and (w.isascii() or unicodedata.normalize("NFC", w).lower().isalpha())]
            found = self._encode_stems(stems)
            found |= self._encode_each([w for w in new if w not in found])
            held = [found[w] if ids is None else ids for w, ids in zip(words, held)]
            if len(self.cache) + len(found) > CACHE_WORDS:
                self.cache = {"": b""}
            self.cache.update(found)
        return held

    def _encode_each(self, texts: list[str]) -> dict[str, bytes]:
        if not texts:
            return {}
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return {t: np.array(e.ids, dtype="<i4").tobytes() for t, e in zip(texts, encoded)}

    def _encode_stems(self, stems: list[str]) -> dict[str, bytes]:
        """Runs of letters, many to a text: the last token of each ends a word, so it shows where the next begins."""
        if not stems:
            return {}
        joined = [" ".join(stems[k:k + STEMS]) for k in range(0, len(stems), STEMS)]
        encoded = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, dtype="<i4") for e in encoded])
        ends = 4 * (np.flatnonzero(self.ends_word[ids]) + 1)
        if len(ends) != len(stems) or ends[-1] != 4 * len(ids):
            return {}
        data = ids.tobytes()
        return {t: data[a:b] for t, a, b in zip(stems, [0, *ends[:-1].tolist()], ends.tolist())}


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per worker process."""
    return WordEncoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write (doc_id, block, block_start, n_tokens, ids) as ORC, ascending by document id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer_path)
        for batch in slices(batches, "text", SLICE_BYTES):
            flat, bounds = enc.encode(batch.column("text"), end_id)
            ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(batch.num_rows, block, dtype=np.int32)),
                 pa.array(total + bounds[:-1]), pa.array(np.diff(bounds)), ids],
                names=["doc_id", "block", "block_start", "n_tokens", "ids"])
            total += int(bounds[-1])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    (rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(run, f"doc_id {kind}, block int, block_start long, n_tokens long, ids array<int>")
     .write.options(**ORC_OPTIONS).orc(path))


def placed(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` of ``files`` (block, block_start, n_tokens and more) and start, the ids of all documents before."""
    totals = files.groupBy("block").agg(F.max(F.col("block_start") + F.col("n_tokens")).alias("held"))
    # One row per range of the write, as many as its shuffle had partitions: small enough to sum and to broadcast.
    offsets = totals.select("block", F.expr(
        "sum(held) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - held"
    ).alias("before"))
    return rows.join(F.broadcast(offsets), "block").withColumn(
        "start", F.col("before") + F.col("block_start")).drop("before")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every row of the files."""
    files = spark.read.orc(path)
    return placed(files, files).select("doc_id", "start", "n_tokens", "ids")


def with_crc(rows: DataFrame) -> DataFrame:
    """``rows`` of the files with ``ids`` replaced by ``ids_crc32``, the CRC-32 of its little-endian 32-bit integers."""
    kept = [c for c in rows.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            data = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4")
            ends = ids.offsets.to_numpy()
            crc = [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(crc, pa.int64())],
                                             names=[*kept, "ids_crc32"])

    added = StructType.fromDDL("ids_crc32 long")
    return rows.mapInArrow(run, StructType([rows.schema[c] for c in kept] + added.fields))
