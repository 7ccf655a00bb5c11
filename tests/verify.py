"""Runs registered queries against their SQL and reports differences: ``python tests/verify.py [sf] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def sortable(row):
    return tuple((v is not None, type(v).__name__, v) for v in row)


def open_tables(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(df, con, sql: str) -> str | None:
    """None when Spark and SQL agree on column names, row count and every value; else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=sortable)
    at = [names.index(c) for c in order]
    want = sorted((tuple(plain(r[i]) for i in at) for r in want), key=sortable)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if g != w or [type(x) for x in g] != [type(x) for x in w]:
            diff = [(c, a, b) for c, a, b in zip(order, g, w) if a != b or type(a) is not type(b)]
            return f"first difference (of {len(got)} rows): {str(diff)[:700]}"
    return None if got else "no rows"


def main(argv: list[str]) -> int:
    from foliospark.plans import QUERIES, SQL
    from foliospark.session import build_session

    sf = argv[0] if argv else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("verify", 8)
    con = open_tables(folder)
    names = [n for n in QUERIES if not argv[1:] or any(p in n for p in argv[1:])]
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            result = compare(df, con, SQL[name]) if name in SQL else f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001
            result = f"{type(e).__name__}: {str(e)[:900]}"
        ok = result is None or result.startswith("rows only")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {result or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
