"""Runs named queries on Spark and in DuckDB over the same tables and compares them.

    python tools/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import pathlib
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from spanledger.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows_of(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.itertuples(index=False, name=None)))


def kinds(df: pd.DataFrame) -> dict:
    out = {}
    for c in df.columns:
        k = str(df[c].dtype)
        out[c] = "str" if k in ("object", "string", "str") else k
    return out


def compare(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} vs {len(sql_df)}"
    a, b = kinds(spark_df), kinds(sql_df)
    if a != b:
        return f"types {({c: (a[c], b[c]) for c in a if a[c] != b[c]})}"
    ra, rb = rows_of(spark_df), rows_of(sql_df)
    if ra != rb:
        only = [x for x in ra if x not in set(rb)][:2], [x for x in rb if x not in set(ra)][:2]
        return f"values {str(only)[:600]}"
    return "ok"


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from spanledger.plans import catalog
    spark, con = local_session(), connect(args.sf)
    bad = 0
    for name in args.names or list(catalog.QUERIES):
        t0 = time.time()
        try:
            got = catalog.QUERIES[name](spark, args.sf).toPandas()
            took = time.time() - t0
            if name not in catalog.ORACLES:
                result = "rows-only"
            else:
                result = compare(got, con.execute(catalog.ORACLES[name]).fetchdf())
        except Exception as exc:  # report and go on with the next query
            got, took, result = [], time.time() - t0, f"{type(exc).__name__}: {str(exc)[:500]}"
        bad += result not in ("ok", "rows-only")
        print(f"{name:24s} {len(got):7d} rows {took:6.2f}s  {result}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
