"""Search predicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches_any(columns: Sequence[str], pattern: str, literal: bool = False) -> Column:
    """True if any column matches ``pattern`` case-insensitively; NULL cells never match.

    By default the pattern is a regular expression (Java syntax; letters of all
    scripts fold, not only ASCII), like pandas' ``str.contains(case=False)``. ``literal=True`` searches for the plain text.
    """
    def one(c: str) -> Column:
        if literal:
            hit = F.lower(F.col(c)).contains(pattern.lower())
        else:
            hit = F.col(c).rlike("(?iu)" + pattern)
        return F.coalesce(hit, F.lit(False))

    return reduce(lambda a, b: a | b, (one(c) for c in columns))
