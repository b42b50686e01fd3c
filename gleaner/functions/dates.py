"""Date parameters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_of_date(as_of: str | dt.date | None) -> Column:
    """The reference date of date-relative metrics; ``None`` means today (session zone)."""
    return F.current_date() if as_of is None else F.to_date(F.lit(str(as_of)))
