"""Order-insensitive comparison of a Spark result with DuckDB rows."""

from __future__ import annotations

import datetime as dt
import math


def _norm(v):
    if v is None:
        return (0, "")
    if hasattr(v, "item") and not isinstance(v, (dt.date, dt.datetime)):
        v = v.item()
    if isinstance(v, bool):
        return (1, int(v))
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (1, float(f"{v:.12g}"))
    if isinstance(v, int):
        return (1, v)
    if isinstance(v, dt.datetime):
        return (2, v.replace(tzinfo=None).isoformat())
    if isinstance(v, dt.date):
        return (2, v.isoformat())
    return (3, str(v))


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def duck_rows(con, sql):
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def assert_same(df, con, sql):
    cols, rows = duck_rows(con, sql)
    got_cols, got = canon(df.columns, [tuple(r) for r in df.collect()])
    want_cols, want = canon(cols, rows)
    assert got_cols == want_cols
    assert len(got) == len(want), f"{len(got)} rows, oracle {len(want)}"
    assert got == want
