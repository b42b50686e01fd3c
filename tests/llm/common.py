"""Rows that every operator must take, and helpers to compare results."""

from __future__ import annotations

import random
import string

SMALL = "/root/testdata/sf0.001"

LONG = "lorem ipsum " * 20_000


def odd_docs(spark, rows=None):
    """Documents with NULLs, empty and very long texts, repeated rows, and columns named like the operators' own."""
    rows = rows if rows is not None else [
        (1, "Plain words that say a few things in one line.\nAnd a second line.", "en", "a", 10),
        (2, None, "en", "a", None),
        (3, "", None, "a", 0),
        (4, LONG, "en", None, len(LONG)),
        (5, "same text here in both rows", "en", "b", 5),
        (5, "same text here in both rows", "en", "b", 5),
        (6, "same text here in both rows", None, "b", 5),
        (None, "a row without an id", "de", "b", 1),
        (7, " \t\n \r\n", "de", "b", 1),
        (8, "été déjà vu ▁ 漢字 😀 <|endoftext|> \x1c x", "fr", "c", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = ("id", "host", "path", "line", "lines", "size", "kept", "score", "ids", "key", "t", "rep", "row",
             "_row", "_id", "_host", "_drop", "_size", "n", "of", "class_id", "target", "taken")
    for name in extra:
        df = df.withColumn(name, df["doc_id"] * 0)
    return df


def no_docs(spark):
    return odd_docs(spark, [])


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def random_words(seed, n, alphabet=string.ascii_lowercase, longest=7):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, longest))) for _ in range(n)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
