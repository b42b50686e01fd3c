"""License scan: fixed phrases, and fuzzy search for short notices with spans.

A text becomes its words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing
A-Z) with single spaces between. Phrases are found as consecutive words. A
notice of m characters may differ by ``EDITS_PER_100`` * m / 100 edits: it is split
into one piece more than it may have edits, so every match holds a piece
unchanged (pigeonhole); exact search for the pieces gives the places. Most places
are chance: the least edits of the notice against the place's surroundings, by a
bit-parallel automaton (a few operations on one integer a letter), rule them out;
the ``regex`` library's bounded-error matching verifies the others and gives span
and edits.
Misspelled phrases (``MISSPELT``) are found in the same way, as whole words, and
stand among the notices; phrases themselves stay exact.

Every text is scanned where it is read, without a shuffle.

Defined cases: NULL and empty texts have no words and no license; repeated rows
give equal results; an empty table gives an empty result; only the id and text
columns are read, so other columns cannot clash. Texts are scanned whole.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.flat import slices

# The phrases of the contract and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of common notices, in the normal form of a text, and their labels.
NOTICES = {
    "licensed under the gnu general public license": "gpl",
    "under the terms of the gnu general public license": "gpl",
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under a creative commons attribution": "cc-by",
    "under the terms of the gnu lesser general public license": "lgpl",
    "subject to the terms of the mozilla public license": "mpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}

EDITS_PER_100 = 10

# Phrases that may be misspelled, as whole words: label, and the pieces of which a match holds one
# unchanged. No letter of "mit" may differ ("it license", "permit license"); "cc by" is too short for an edit.
MISSPELT = {
    "(?:gnu general public license){e<=2}": ("gpl", ("gnu gene", "ral publi", "c license")),
    "(?:apache license){e<=1}": ("apache", ("apache ", "license")),
    "mit (?:license){e<=1}": ("mit", (" mit ",)),
}

_WORD = frozenset([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(NORMAL).split() if text else []


class Blanks:
    """Where the blanks of a normal text stand; word k lies between blanks k and k + 1. Found when first asked for."""

    def __init__(self, normal: bytes):
        self.normal = normal
        self.at: list[int] | None = None

    def list(self) -> list[int]:
        if self.at is None:
            self.at = np.flatnonzero(np.frombuffer(self.normal, dtype=np.uint8) == 0x20).tolist()
        return self.at

    def word(self, end: int) -> int:
        """The word that follows the last blank before ``end``."""
        return bisect_left(self.list(), end) - 1


@lru_cache(maxsize=1)
def searches() -> list[tuple]:
    """(label, notice, edits, compiled pattern, [(piece, place in the notice)], letter masks) of each notice."""
    import regex

    out = []
    for notice, label in NOTICES.items():
        edits = max(1, len(notice) * EDITS_PER_100 // 100)
        cuts = [len(notice) * k // (edits + 1) for k in range(edits + 2)]
        pieces = [(notice[a:b].encode(), a) for a, b in zip(cuts[:-1], cuts[1:])]
        out.append((label, notice.encode(), edits,
                    regex.compile(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}"), pieces,
                    letter_masks(notice.encode())))
    return out


def letter_masks(pattern: bytes) -> dict[int, int]:
    """Bit i of a letter's mask: the pattern has it at place i."""
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def least_edits(masks: dict[int, int], size: int, part: bytes) -> int:
    """The fewest edits by which a pattern of ``size`` letters matches anywhere in ``part`` (Myers' bit vectors)."""
    whole, last = (1 << size) - 1, 1 << (size - 1)
    up, down, score, best = whole, 0, size, size  # vertical differences of +1 and of -1
    for c in part:
        same = masks.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same
        right = down | (~(diagonal | up) & whole)
        left = up & diagonal
        score += bool(right & last) - bool(left & last)
        best = score if score < best else best
        right, left = (right << 1) & whole, (left << 1) & whole
        up, down = left | (~(same | down | right) & whole), right & (same | down)
    return best


def places(normal: bytes, phrase: bytes) -> list[int]:
    """Offsets of all occurrences, overlapping ones too."""
    out, at = [], normal.find(phrase)
    while at >= 0:
        out.append(at)
        at = normal.find(phrase, at + 1)
    return out


def fuzzy(normal: bytes, blanks: Blanks) -> list[tuple[str, int, int, int]]:
    """(label, first word, last word, edits) of each notice place, best match of overlapping ones."""
    found = set()
    for label, notice, edits, pattern, pieces, masks in searches():
        covered = None  # places inside a match
        known: dict[bytes, tuple[int, int, int] | None] = {}  # parts that were searched before
        for piece, offset in pieces:
            for at in places(normal, piece):
                if covered is not None and covered[at]:
                    continue
                low, high = max(0, at - offset - edits), min(len(normal), at - offset + len(notice) + edits)
                part = normal[low:high]
                if part not in known:
                    known[part] = None
                    if part.find(notice) >= 0:
                        known[part] = (part.find(notice), part.find(notice) + len(notice), 0)
                    elif least_edits(masks, len(notice), part) <= edits:
                        match = pattern.search(part.decode("latin-1"))
                        known[part] = (match.start(), match.end(), sum(match.fuzzy_counts))
                if known[part]:
                    a, b = low + known[part][0], low + known[part][1]
                    covered = covered if covered is not None else bytearray(len(normal))
                    covered[a:b] = b"\1" * (b - a)
                    lead = len(normal[a:b]) - len(normal[a:b].lstrip())
                    found.add((label, blanks.word(a + lead + 1), blanks.word(max(a + 1, a + len(normal[a:b].rstrip()))),
                               known[part][2]))
    return sorted(found)


@lru_cache(maxsize=1)
def misspelt_searches() -> list[tuple]:
    """(label, compiled pattern, pieces, letters of a match: fewest and most) of each phrase of ``MISSPELT``."""
    import regex

    out = []
    for pattern, (label, pieces) in MISSPELT.items():
        plain, edits = regex.sub(r"\(\?:|\)|\{e<=\d\}", "", pattern), int(regex.search(r"e<=(\d)", pattern)[1])
        out.append((label, regex.compile(f"(?b){pattern}"), [p.encode() for p in pieces],
                    (len(plain) - edits, len(plain) + edits)))
    return out


def misspelt(normal: bytes, blanks: Blanks, notices: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """(label, first word, last word, edits) of each misspelled phrase, best match of overlapping ones.

    Not those that are a phrase unchanged or lie in one of ``notices`` with the same label.
    """
    found = []
    for label, pattern, pieces, (fewest, most) in misspelt_searches():
        near = {at for piece in pieces for at in places(normal, piece)}
        if not near:
            continue
        at_blank = blanks.list()
        tried: dict[tuple[int, int], int] = {}
        known: dict[bytes, int] = {}
        for at in near:
            k = bisect_right(at_blank, at) - 1
            for first in range(k, -1, -1):
                a = at_blank[first] + 1
                if at - at_blank[first] > most:
                    break
                for last in range(k, len(at_blank) - 1):
                    b = at_blank[last + 1]
                    if b - a > most:
                        break
                    if b - a < fewest or (first, last) in tried:
                        continue
                    part = normal[a:b]
                    if part not in known:
                        match = pattern.fullmatch(part.decode("latin-1"))
                        known[part] = sum(match.fuzzy_counts) if match else -1
                    tried[first, last] = known[part]
        taken: set[int] = set()
        inside = {k for x in notices if x[0] == label for k in range(x[1], x[2] + 1)}
        for edits, first, last in sorted((e, a, b) for (a, b), e in tried.items() if e >= 0):
            if taken.isdisjoint(range(first, last + 1)):
                taken.update(range(first, last + 1))
                if edits and inside.isdisjoint(range(first, last + 1)):
                    found.append((label, first, last, edits))
    return found


def scan_text(text: str | None) -> tuple:
    """(n_words, [(label, first word)] of phrases, [(label, first, last, edits)] of notices)."""
    words = words_of(text)
    normal = b" " + b" ".join(words) + b" "
    blanks = Blanks(normal)
    base = [(label, blanks.word(at + 1)) for phrase, label in PHRASES.items()
            for at in places(normal, f" {phrase} ".encode())]
    notices = fuzzy(normal, blanks) if words else []
    return len(words), sorted(base), sorted(notices + misspelt(normal, blanks, notices))


SPAN = "struct<label:string,first_word:bigint,last_word:bigint,edits:int>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, phrases array of (label, first_word), notices array of spans) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_base = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())]))
        kind_span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()),
                                        ("last_word", pa.int64()), ("edits", pa.int32())]))
        for batch in slices(batches, "text"):
            rows = [scan_text(t) for t in batch.column("text").to_pylist()]
            base = [[{"label": x[0], "first_word": x[1]} for x in r[1]] for r in rows]
            spans = [[dict(zip(("label", "first_word", "last_word", "edits"), x)) for x in r[2]] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([r[0] for r in rows], pa.int64()),
                 pa.array(base, kind_base), pa.array(spans, kind_span)],
                names=["id", "n_words", "phrases", "notices"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, phrases array<struct<label:string,first_word:bigint>>, notices array<{SPAN}>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def summary(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One digest row per document: counts, first and last place, labels and a score from 0 to 1.

    The score is 1 with a phrase, else that of the notice with the fewest edits: 1 less 0.1 for each edit, at least 0.1.
    """
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    least = F.array_min(F.col("notices.edits"))
    return scanned.select(
        id_col, "n_words", F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.first_word").alias("first_word"),
        F.array_max("phrases.first_word").alias("last_word"),
        join(F.col("phrases.label")).alias("base_labels"),
        join(F.concat("phrases.label", "notices.label")).alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).when(least.isNotNull(), F.greatest(F.lit(0.1), 1 - 0.1 * least))
        .otherwise(0.0).alias("score"), F.size("notices").cast("long").alias("n_notices"))
