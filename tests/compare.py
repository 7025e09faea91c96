"""Run registered queries against their SQL oracles: ``python tests/compare.py <sf> [names...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

import __spark_entry__ as entry
from docloom.plans.base import TABLES


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0 if v != int(v) else int(v)) if math.isfinite(v) else repr(v)
    if isinstance(v, int):
        return repr(v)
    return str(v)


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder: str, name: str):
    """(ok, message, seconds, rows)"""
    t0 = time.time()
    df = entry.queries()[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, "no oracle", took, len(got)
    con.execute(sql)
    names = [d[0] for d in con.description]
    want = con.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {df.columns} != {names}", took, len(got)
    a, b = canonical(got, df.columns), canonical(want, names)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3]
        only_b = [r for r in b if r not in set(a)][:3]
        return False, f"{len(a)} vs {len(b)} rows; {sorted(names)}\n   spark {only_a}\n   sql   {only_b}", took, len(got)
    return True, "ok", took, len(got)


def main() -> None:
    from docloom.session import get_session
    folder = f"/root/testdata/sf{sys.argv[1]}"
    names = sys.argv[2:] or list(entry.queries())
    spark = get_session("compare", "local[8]", 8, "12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for n in names:
        try:
            ok, msg, took, rows = compare(spark, con, folder, n)
        except Exception as e:  # report and go on
            ok, msg, took, rows = False, f"{type(e).__name__}: {str(e)[:1500]}", 0.0, 0
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {n:24s} {took:6.2f}s rows={rows} {'' if msg == 'ok' else msg}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
