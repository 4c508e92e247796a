"""Run registered queries in Spark and their SQL twins in DuckDB; compare.

Usage: python tests/oracle_compare.py [sf_dir] [query ...]
Mirrors the driver's gate: column names, row count and an order-insensitive
hash of rows with columns sorted by name.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from codecorpus.session import local_session  # noqa: E402
from codecorpus.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        df = fn(spark, sf)
        rows = [tuple(r) for r in df.collect()]
        ts = time.time() - t0
        if name not in sqls:
            print(f"{name:40s} spark rows={len(rows)} ({ts:.1f}s) [no oracle]")
            continue
        t0 = time.time()
        res = con.execute(sqls[name])
        ocols = [c[0] for c in res.description]
        orows = res.fetchall()
        to = time.time() - t0
        h1, l1 = digest(df.columns, rows)
        h2, l2 = digest(ocols, orows)
        ok = sorted(df.columns) == sorted(ocols) and len(rows) == len(orows) and h1 == h2
        bad += not ok
        print(f"{name:40s} {'OK ' if ok else 'BAD'} rows={len(rows)}/{len(orows)} spark {ts:.1f}s duckdb {to:.1f}s")
        if not ok:
            print("   cols", sorted(df.columns), sorted(ocols))
            diff1 = [x for x in l1 if x not in set(l2)][:3]
            diff2 = [x for x in l2 if x not in set(l1)][:3]
            print("   spark-only", [x[:300] for x in diff1])
            print("   duck-only ", [x[:300] for x in diff2])
    print("mismatches", bad)


if __name__ == "__main__":
    main()
