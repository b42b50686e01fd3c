"""Derive a k-times larger copy of the driver's tables (for scaling checks only).

Usage: python tools/scale_up.py SRC_DIR DST_DIR K
Copy i shifts every key by i * (max key + 1), so references stay intact;
nation and region are shared. Names repeat across copies (namesakes).
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from gleaner.session import local_session  # noqa: E402

KEYS = {  # table -> {column: key space}
    "customer": {"c_custkey": "cust"},
    "supplier": {"s_suppkey": "supp"},
    "orders": {"o_orderkey": "order", "o_custkey": "cust"},
    "lineitem": {"l_orderkey": "order", "l_suppkey": "supp"},
}
SPACES = {"cust": ("customer", "c_custkey"), "supp": ("supplier", "s_suppkey"),
          "order": ("orders", "o_orderkey")}


def main(src: str, dst: str, k: int) -> None:
    spark = local_session()
    span = {s: spark.read.parquet(f"{src}/{t}.parquet").agg(F.max(c)).first()[0] + 1
            for s, (t, c) in SPACES.items()}
    for t in ("nation", "region"):
        spark.read.parquet(f"{src}/{t}.parquet").write.mode("overwrite").parquet(f"{dst}/{t}.parquet")
    for t, cols in KEYS.items():
        df = spark.read.parquet(f"{src}/{t}.parquet")
        out = df.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))))
        for c, space in cols.items():
            out = out.withColumn(c, F.col(c) + F.col("_copy") * F.lit(span[space]))
        out.drop("_copy").write.mode("overwrite").parquet(f"{dst}/{t}.parquet")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], int(sys.argv[3]))
