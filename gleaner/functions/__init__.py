"""Column expressions and small DataFrame helpers shared by the operators."""

from gleaner.functions.agg import count_by, count_rows, order_desc, share_of_total, topk
from gleaner.functions.dates import as_of_date
from gleaner.functions.text import matches_any

__all__ = ["as_of_date", "count_by", "count_rows", "order_desc", "share_of_total", "topk",
           "matches_any"]
