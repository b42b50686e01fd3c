"""Search over stored rows that skips files by trigram signatures.

Rows are stored sorted by their searched columns. Each file has a signature: a
bitmap of ``BITS`` bits, one for each trigram (by a hash) that some searched cell of
the file holds, letters folded. A pattern's matches must hold certain literal
runs; a file whose signature lacks a trigram of every alternative cannot hold a
match and is not read. The files that are left are searched by the pattern itself,
so rows equal those of a scan of all files.

What a pattern must hold is read off cautiously: plain characters outside groups,
classes and options, of each alternative. A pattern with an alternative that has
no three such characters in a row, with flags or with unusual escapes prunes
nothing: then all files are read, by definition.

Folding covers what case-insensitive matching can turn into ASCII letters; other
characters end a run. Cells that are NULL or shorter than three hold no trigram,
and no pattern that prunes matches them.
"""

from __future__ import annotations

import zlib
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import matches_any

BITS = 1 << 15  # one bitmap of Spark's bitmap functions
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Characters that case folding turns into ASCII letters, and those letters.
FOLDED = (UPPER + "ſKİı", UPPER.lower() + "skii")


def grams_of(run: str) -> list[str]:
    """The trigrams of a literal run, folded."""
    run = run.translate(str.maketrans(*FOLDED))
    return [run[k:k + 3] for k in range(len(run) - 2)]


def place(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BITS


def literal_runs(pattern: str) -> list[list[str]] | None:
    """For each alternative of a regular expression, runs of ASCII characters that every match holds; None if unknown."""
    branches: list[list[str]] = [[]]
    run, k, n = "", 0, len(pattern)

    def end() -> None:
        nonlocal run
        branches[-1].append(run)
        run = ""

    while k < n:
        c = pattern[k]
        if c == "\\":
            if k + 1 == n or pattern[k + 1] in "QEcxuopPkNRXhHvVgGzZ0123456789":
                return None
            if pattern[k + 1].isalnum():  # a class or an anchor
                end()
            else:
                run += pattern[k + 1]
            k += 2
        elif c in "([":
            end()
            k = _closed(pattern, k)
            if k is None:
                return None
        elif c in ")]}":
            return None
        elif c in "?*{":  # what stands before may be missing
            run = run[:-1]
            end()
            k = pattern.find("}", k) + 1 if c == "{" else k + 1
            if not k:
                return None
            k += k < n and pattern[k] in "?+"
        elif c == "+":
            end()
            k += 1
            k += k < n and pattern[k] in "?+"
        elif c == "|":
            end()
            branches.append([])
            k += 1
        elif c in ".^$" or not c.isascii():
            end()
            k += 1
        else:
            run += c
            k += 1
    end()
    return branches


def _closed(pattern: str, k: int) -> int | None:
    """Where a group or class that begins at ``k`` is over; None for groups with options and unclosed ones."""
    depth, in_class = 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            if pattern[k + 1:k + 2] == "Q":
                return None
            k += 1
        elif c == "[":
            in_class += 1
            k += pattern[k + 1:k + 2] == "^"
            k += pattern[k + 1:k + 2] == "]"
        elif c == "]" and in_class:
            in_class -= 1
            if not in_class and not depth:
                return k + 1
        elif not in_class and c == "(":
            if pattern[k + 1:k + 2] == "?":
                return None
            depth += 1
        elif not in_class and c == ")":
            depth -= 1
            if not depth:
                return k + 1
        k += 1
    return None


def needed(pattern: str, literal: bool = False) -> list[list[int]] | None:
    """For each alternative, the bits that a file must have to hold a match; None if nothing can be said."""
    if literal:
        plain = "".join(c if c.isascii() else "\n" for c in pattern)
        runs = [plain.split("\n")]
    else:
        runs = literal_runs(pattern)
    if runs is None:
        return None
    bits = [sorted({place(g) for run in branch for g in grams_of(run)}) for branch in runs]
    return bits if all(bits) else None


def _cell_grams(column: str) -> Column:
    cell = F.translate(F.col(f"`{column}`"), *FOLDED)
    at = F.when(F.length(cell) >= 3, F.sequence(F.lit(1), F.length(cell) - 2))
    return F.coalesce(F.transform(at, lambda k: F.substring(cell, k, F.lit(3))), F.array().cast("array<string>"))


def store(df: DataFrame, path: str, columns: list[str], files: int | None = None) -> None:
    """Write ``df`` sorted by the searched columns, and each file's signature beside the data."""
    tied = df.withColumn("_tie", F.monotonically_increasing_id())  # splits many equal rows over files
    ranged = tied.repartitionByRange(files, *columns, "_tie") if files else tied.repartitionByRange(*columns, "_tie")
    ranged.sortWithinPartitions(*columns).drop("_tie").write.parquet(f"{path}/data")
    stored = df.sparkSession.read.schema(df.schema).parquet(f"{path}/data")
    grams = F.flatten(F.array(*(_cell_grams(c) for c in columns)))
    bit = F.crc32(F.encode("gram", "UTF-8")) % BITS + 1  # bit positions count from 0, their values from 1
    # Every task builds the bitmap of its part of a file before the shuffle: one small row a task and file.
    signed = (stored.select(F.col("_metadata.file_path").alias("file"), F.explode_outer(grams).alias("gram"))
              .groupBy("file").agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("grams")))
    signed.write.parquet(f"{path}/signatures")


def _has(bit: int) -> Column:
    byte = F.conv(F.hex(F.substring("grams", bit // 8 + 1, 1)), 16, 10).cast("int")
    return F.shiftright(byte, bit % 8).bitwiseAND(F.lit(1)) == 1


def files_to_read(spark: SparkSession, path: str, pattern: str, literal: bool = False) -> tuple[list[str], int]:
    """The files that can hold a match, and how many there are in all. The signatures stay distributed; names of the
    files that are left come back, as many as the read opens."""
    signatures = spark.read.schema("file string, grams binary").parquet(f"{path}/signatures")
    bits = needed(pattern, literal)
    kept = signatures
    if bits is not None:
        possible = F.lit(False)
        for branch in bits:
            all_of = F.lit(True)
            for b in branch:
                all_of &= _has(b)
            possible |= all_of
        kept = signatures.where(possible)
    return sorted(unquote(r["file"]) for r in kept.select("file").collect()), signatures.count()


def search(spark: SparkSession, path: str, schema: T.StructType, columns: list[str], pattern: str | None,
           literal: bool = False) -> DataFrame:
    """The stored rows of which a searched cell matches; a blank pattern gives all."""
    everything = spark.read.schema(schema).parquet(f"{path}/data")
    if pattern is None or pattern.strip() == "":
        return everything
    files, total = files_to_read(spark, path, pattern, literal)
    if not files:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*files) if len(files) < total else everything
    return rows.where(matches_any(columns, pattern, literal))
