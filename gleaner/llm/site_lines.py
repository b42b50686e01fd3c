"""Line dedup by site-relative frequency: lines on a large share of a host's pages are boilerplate.

A line (trimmed of blanks, by its MD5) counts once per page. Counts are grouped
by (host, line) with a partial aggregate, so a host or a line with a third of
all rows is summed before it is shuffled; lines on fewer than ``min_pages`` pages
leave, and the others are divided by the host's page total. A host's boilerplate
lines number at most its mean lines per page / ``ratio``, so they are kept as one
array per host; pages are joined to it by host (a large host's pages are split
by adaptive skew handling where the arrays are too large to broadcast) and lose
those lines.

With ``per_text`` a line counts once per distinct text of the host (by its MD5, in a
two-level distinct count) and is divided by the host's distinct texts, so the
copies of one document do not make its lines boilerplate; near copies are
distinct texts. ``corpus_pipeline`` counts so; ``op1_site_lines`` counts rows, as its oracle does.

``documents`` have no URL: the host is ``source``.

Defined cases: NULL text stays NULL (0 lines) and counts as a page; blank lines
are never counted nor dropped; a text that loses all lines becomes empty; NULL
hosts are one host; each row is a page, repeated rows too (with ``per_text`` each
distinct text, and NULL is none); an empty table gives an empty result; columns of other names are passed through or not read; texts are read whole,
a very long one as one array of its lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.flat import fresh
from gleaner.llm.lineage import cut

RATIO = 0.1
MIN_PAGES = 5

#: For distinct texts. On sf0.1 15 lines have a larger share in one source at least; the most frequent license
#: line has 1.8% (README).
TEXT_RATIO = 0.02
BLANKS = " \t\r"


def _key(line: F.Column) -> F.Column:
    """The line's identity; NULL for a blank line."""
    trimmed = F.btrim(line, F.lit(BLANKS))
    return F.when(trimmed != "", F.unhex(F.md5(trimmed)))


def boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES,
                text_col: str = "text", host_col: str = "source", per_text: bool = False) -> DataFrame:
    """(host, lines): the keys of lines on more than ``ratio`` of the host's pages, hosts without any left out."""
    pages = docs.select(F.col(f"`{host_col}`").alias("host"), F.col(f"`{text_col}`").alias("text"))
    pages = pages.withColumn("page", F.unhex(F.md5("text")) if per_text else F.lit(1))
    number = F.count_distinct("page") if per_text else F.count("page")
    keys = F.array_distinct(F.array_compact(F.transform(F.split("text", "\n"), _key)))
    counts = (pages.select("host", "page", F.explode(keys).alias("line")).groupBy("host", "line")
              .agg(number.alias("n")).where(F.col("n") >= min_pages))
    totals = pages.groupBy(F.col("host").alias("of")).agg(number.alias("pages"))
    return (counts.join(totals, F.col("host").eqNullSafe(F.col("of")))
            .where(F.col("n") > ratio * F.col("pages"))
            .groupBy("host").agg(F.collect_list("line").alias("lines")))


def clean(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, text_col: str = "text",
          host_col: str = "source", n_lines: str | None = None, n_dropped: str | None = None,
          per_text: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines gone from the text; line counts in columns of the given names."""
    # Written, so that its size is known: as small as it is, texts are not shuffled to meet it.
    found = cut(boilerplate(docs, ratio, min_pages, text_col, host_col, per_text), "boilerplate")
    host, drop = fresh(docs, "_host"), fresh(docs, "_drop")
    found = found.select(F.col("host").alias(host), F.col("lines").alias(drop))
    rows = docs.join(found, F.col(f"`{host_col}`").eqNullSafe(F.col(host)), "left")
    lines = F.split(F.col(f"`{text_col}`"), "\n")
    left = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col(drop), _key(x)), F.lit(False)))
    text = F.when(F.col(drop).isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(left, "\n"))
    out = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    count = lambda x: F.coalesce(F.size(x), F.lit(0))
    if n_lines:
        out.append(F.when(F.col(f"`{text_col}`").isNull(), 0).otherwise(count(lines)).alias(n_lines))
    if n_dropped:
        out.append(F.when(F.col(drop).isNull() | F.col(f"`{text_col}`").isNull(), 0)
                   .otherwise(count(lines) - count(left)).alias(n_dropped))
    return rows.select(*out)


ORACLE = f"""
WITH pages AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
keyed AS (SELECT DISTINCT md5(text) AS page, source, trim(line, ' ' || chr(9) || chr(13)) AS k
          FROM (SELECT text, source, unnest(ls) AS line FROM pages)),
counts AS (SELECT source, k, COUNT(*) AS n FROM keyed WHERE k <> '' GROUP BY source, k),
totals AS (SELECT source, COUNT(DISTINCT text) AS pages FROM documents GROUP BY source),
found AS (SELECT c.source, list(c.k) AS gone FROM counts c
          JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
          WHERE c.n >= {MIN_PAGES} AND c.n > CAST({TEXT_RATIO} AS DOUBLE) * t.pages GROUP BY c.source),
kept AS (SELECT p.doc_id, p.text, p.ls, f.gone, list_filter(p.ls, lambda x:
           NOT list_contains(coalesce(f.gone, []), trim(x, ' ' || chr(9) || chr(13)))) AS stay
         FROM pages p LEFT JOIN found f ON p.source IS NOT DISTINCT FROM f.source)
SELECT doc_id,
       CASE WHEN text IS NULL THEN NULL WHEN gone IS NULL THEN text
            ELSE coalesce(array_to_string(stay, chr(10)), '') END AS text,
       CAST(CASE WHEN text IS NULL THEN 0 ELSE len(ls) END AS INTEGER) AS n_lines,
       CAST(CASE WHEN text IS NULL THEN 0 ELSE len(ls) - len(stay) END AS INTEGER) AS n_dropped
FROM kept
"""
