"""Grouping, ranking and share helpers.

Ordering rule used everywhere (ties are real in the data): the measure
descending with NULLs last, then the output keys ascending with NULLs first,
so a LIMIT always returns the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_ORDERED: ContextVar[bool] = ContextVar("ordered", default=True)


@contextmanager
def unordered() -> Iterator[None]:
    """Queries built inside leave out a final ORDER BY (not the order of a LIMIT): for results that go to files."""
    token = _ORDERED.set(False)
    try:
        yield
    finally:
        _ORDERED.reset(token)


def count_rows(alias: str) -> Column:
    """``COUNT(*)``: every row, NULL keys included."""
    return F.count(F.lit(1)).alias(alias)


def count_by(df: DataFrame, keys: Sequence[str] | str, alias: str) -> DataFrame:
    """Rows per group (``GROUP BY keys``, ``COUNT(*)``); partial + final aggregate."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(count_rows(alias))


def _order(measure: str, keys: Sequence[str]) -> list[Column]:
    return [F.col(measure).desc_nulls_last()] + [F.col(k).asc_nulls_first() for k in keys]


def order_desc(df: DataFrame, measure: str, keys: Sequence[str] | str) -> DataFrame:
    """Total order: measure descending, keys ascending as tie-break."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.orderBy(*_order(measure, keys)) if _ORDERED.get() else df


def topk(df: DataFrame, measure: str, n: int, keys: Sequence[str] | str) -> DataFrame:
    """First ``n`` rows under :func:`order_desc` (planned as TakeOrderedAndProject)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.orderBy(*_order(measure, keys)).limit(n)


def share_of_total(grouped: DataFrame, count_col: str, alias: str) -> DataFrame:
    """Add ``100 * count / total`` where total is the sum over the grouped rows.

    The total is an uncorrelated scalar subquery over the already grouped
    result, so the large input is scanned once and its shuffle is reused. An
    empty input has no groups and therefore never divides.
    """
    total = grouped.agg(F.sum(count_col)).scalar()
    return grouped.withColumn(alias, F.col(count_col) * F.lit(100.0) / total)
