"""Run registered queries in Spark and their SQL in DuckDB and compare rows, order aside."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
import pandas as pd


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def cell(v) -> str:
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "<null>"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) and v == int(v):
        return str(int(v))
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    names = sorted(df.columns)
    frame = df[names].astype(object).where(df[names].notna(), None)
    return sorted(tuple(cell(v) for v in r) for r in frame.itertuples(index=False))


def difference(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    got = spark_df.toPandas()
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a == b:
        return None
    only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return f"{len(a)} vs {len(b)} rows; {sorted(got.columns)}\n   spark  {only_a}\n   oracle {only_b}"


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from offerloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = local_session(8)
    con = oracle_connection(sf)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = difference(fn(spark, sf), con, sqls[name])
                state = "equal" if problem is None else "DIFFERENT"
            else:
                problem, state = None, f"rows only: {fn(spark, sf).count()}"
        except Exception as e:  # report and go on with the next query
            problem, state = f"{type(e).__name__}: {str(e)[:1500]}", "FAILED"
        bad += problem is not None
        print(f"{name:34} {time.time() - start:6.2f}s {state}", flush=True)
        if problem:
            print("   " + problem[:2500], flush=True)
    print(f"{bad} problems")


if __name__ == "__main__":
    main()
