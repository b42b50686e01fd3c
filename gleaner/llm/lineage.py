"""Cutting lineage with a written table in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import cut, scratch

__all__ = ["BROADCAST_IDS", "cut", "ids_to_join", "scratch"]

#: Rows of ids that may be broadcast: a few dozen MB in an executor.
BROADCAST_IDS = 1 << 20


def ids_to_join(ids: DataFrame, name: str = "ids") -> DataFrame:
    """``ids`` (one long column), written; to be broadcast if they are at most ``BROADCAST_IDS``, else joined by a shuffle."""
    held = cut(ids, name)
    return F.broadcast(held) if held.count() <= BROADCAST_IDS else held
