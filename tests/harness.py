"""Runs queries against their SQL on the test tables; also a command: python -m tests.harness SF [NAME...]."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

from wakegraph.session import release

DATA = os.environ.get("WAKEGRAPH_TESTDATA", "/root/testdata")


def connect(base: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(base)):
        path = f"{base}/{f}/*.parquet" if os.path.isdir(f"{base}/{f}") else f"{base}/{f}"
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return round(v, 9)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return tuple(_plain(x) for x in v)
    if isinstance(v, pd.Timestamp):
        return str(v)
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, query, sql: str | None, base: str) -> tuple[bool, str]:
    began = time.time()
    df = query(spark, base)
    got = rows_of(df.columns, [list(r) for r in df.collect()])
    release(spark)
    took = time.time() - began
    if sql is None:
        return True, f"{name}: {len(got)} rows, no SQL, {took:.1f} s"
    rel = con.sql(sql)
    names = list(rel.columns)
    want = rows_of(names, rel.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"{name}: columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        return False, f"{name}: {len(got)} and {len(want)} rows; only Spark {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"
    return True, f"{name}: {len(got)} rows agree, {took:.1f} s"


def main(args: list[str]) -> int:
    import __spark_entry__ as entry
    from wakegraph.session import local_session

    base = f"{DATA}/{args[0]}"
    spark, con, bad = local_session(8), connect(base), 0
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in args[1:] or queries:
        try:
            ok, what = compare(spark, con, name, queries[name], sql.get(name), base)
        except Exception as e:  # goes on to the next query
            ok, what = False, f"{name}: {type(e).__name__} {str(e)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", what, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
