"""Statistics of whole texts that quality rules and the quality classifier share.

Words are ``[^\\x20\\x09-\\x0D]+``. Most counts are numpy passes over the bytes of
a slice of texts; repeated lines and windows are counted text by text. NULL and
empty texts have 0 everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.flat import IN_WORD, byte_table, count_per_text, flat_utf8, slices, starts_of
from gleaner.llm.lineage import cut

WINDOW = 5
SYMBOLS = byte_table(b"#*$%&|<>")
UPPER = byte_table(range(ord("A"), ord("Z") + 1))
LETTER = UPPER | byte_table(range(ord("a"), ord("z") + 1)) | byte_table(range(0xC0, 0x100))
MARKS = byte_table(b"!?")
STOPS = byte_table(b".,;:")
DIGITS = byte_table(b"0123456789")
NEXT_OF_CHAR = byte_table(range(0x80, 0xC0))

#: Names of the statistics, in order; all are counts.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters",
         "n_marks", "n_stops", "n_digits", "n_lines", "n_distinct")


def repeated_windows(words: list[bytes]) -> tuple[int, int]:
    """Words in windows of WINDOW words that occur twice or more, and the number of distinct words."""
    numbers: dict[bytes, int] = {}
    n = len(words)
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=n)
    if n <= WINDOW:
        return 0, len(numbers)
    base = len(numbers)
    if base ** WINDOW < 2 ** 62:
        key = ids[:n - WINDOW + 1].copy()
        for k in range(1, WINDOW):
            key = key * base + ids[k:n - WINDOW + 1 + k]
    else:  # exact all the same: number the pairs, then the windows
        key, width = ids, 1
        for k in range(1, WINDOW):
            _, key = np.unique(key[:n - k] * base + ids[k:], return_inverse=True)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0, base
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:n])), base


def stats_of(column: pa.Array) -> np.ndarray:
    """One row of STATS per text."""
    buf, offsets = flat_utf8(column)
    inside = IN_WORD[buf]
    out = np.zeros((len(offsets) - 1, len(STATS)), dtype=np.int64)
    out[:, 0] = count_per_text(starts_of(inside, offsets), offsets)
    out[:, 1] = count_per_text(inside & ~NEXT_OF_CHAR[buf], offsets)
    for k, table in ((2, SYMBOLS), (5, UPPER), (6, LETTER), (7, MARKS), (8, STOPS), (9, DIGITS)):
        out[:, k] = count_per_text(table[buf], offsets)
    data = buf.tobytes()
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        text = data[a:b]
        lines = [line for line in text.split(b"\n") if line and not line.isspace()]
        out[i, 3] = len(lines) - len(set(lines))
        out[i, 10] = len(lines)
        out[i, 4], out[i, 11] = repeated_windows(text.split())
    return out


def ratios(stats: np.ndarray) -> np.ndarray:
    """Statistics as size-free features, one row per text (0 where a denominator is 0)."""
    s = {name: stats[:, k].astype(np.float64) for k, name in enumerate(STATS)}
    words, lines = np.maximum(s["n_words"], 1), np.maximum(s["n_lines"], 1)
    chars, letters = np.maximum(s["word_chars"], 1), np.maximum(s["n_letters"], 1)
    return np.column_stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, np.minimum(s["n_symbols"] / words, 3),
        s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["n_upper"] / letters,
        np.minimum(s["n_marks"] / words, 3), s["n_stops"] / words, s["n_digits"] / chars,
        s["n_distinct"] / words ** 0.8])


def stored_stats(docs: DataFrame, columns: dict[str, str], text_col: str = "text") -> DataFrame:
    """STATS of every row of ``docs``, written once, beside the columns that ``columns`` names (new name: column)."""
    rows = docs.select(*(F.col(c).alias(name) for name, c in columns.items()), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            stats = stats_of(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), *(pa.array(stats[:, k]) for k in range(len(STATS)))],
                names=[*columns, *STATS])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns]
    return cut(rows.mapInArrow(run, ", ".join([*kinds, *(f"{s} long" for s in STATS)])), "stats")


def labelled(stats: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(y, STATS) of every labelled row of ``stats`` (its ids are in ``id``); texts are not joined."""
    marks = labels.where(F.col(label).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label).cast("long").alias("y"))
    return cut(stats.join(marks, "id").select("y", *STATS), "labelled")


def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The statistics and labels of a batch of :func:`labelled` rows."""
    return (np.column_stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATS]),
            batch.column("y").to_numpy(zero_copy_only=False))


def over_all(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray],
             combine: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add) -> np.ndarray | None:
    """``part(stats, y)`` combined over all :func:`labelled` rows; each task sends the driver one array."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                new = part(*arrays(batch))
                held = new if held is None else combine(held, new)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held.tolist()], pa.list_(pa.float64()))], names=["part"])

    got = [np.array(r["part"]) for r in rows.mapInArrow(run, "part array<double>").collect()]
    return reduce(combine, got) if got else None
