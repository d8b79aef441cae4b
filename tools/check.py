"""Run registered queries beside their SQL on DuckDB and compare them.

usage: python tools/check.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from basketry.session import get_session  # noqa: E402

TESTDATA = "/root/testdata"


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0) if v != int(v) or abs(v) > 1e15 else str(int(v))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(norm(r[i]) for i in order) for r in rows)


def connect(sf_dir):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f'CREATE VIEW "{name}" AS SELECT * FROM read_parquet(\'{path}\')')
    return con


def compare(spark, con, sf_dir, fn, sql):
    """Return (ok, message)."""
    df = fn(spark, sf_dir)
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(set(cols)) != len(cols):
        return False, f"duplicate column names {cols}"
    if sql is None:
        return False, f"no SQL to compare {len(got)} rows with"
    res = con.execute(sql)
    ecols, want = rows_of([d[0] for d in res.description], res.fetchall())
    if cols != ecols:
        return False, f"columns {cols} != {ecols}"
    if got != want:
        in_got, in_want = set(got), set(want)
        only_g = [r for r in got if r not in in_want][:3]
        only_w = [r for r in want if r not in in_got][:3]
        return False, f"rows {len(got)} vs {len(want)}\n   spark {only_g}\n   sql   {only_w}"
    return True, f"{len(got)} rows"


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from basketry.plans import oracle_sql, queries

    sf_dir = f"{TESTDATA}/sf{args.sf}"
    spark = get_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            ok, msg = compare(spark, con, sf_dir, fn, sqls.get(name))
        except Exception as exc:  # report and go on with the next query
            ok, msg = False, f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.2f}s {msg}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
