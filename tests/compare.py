"""Run registered queries against their SQL counterparts and report differences.

Usage: python tests/compare.py [sf_dir] [name prefix …]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
        df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or v != v else
                          (repr(float(v)) if isinstance(v, float) else
                           (str(int(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v))))
    return df.fillna("∅").sort_values(list(df.columns)).reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = canonical(got), canonical(want)
    bad = (a != b).any(axis=1)
    if bad.any():
        i = bad.idxmax()
        cols = [c for c in a.columns if a.loc[i, c] != b.loc[i, c]]
        return f"{int(bad.sum())} rows differ, e.g. {cols}: {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}"
    return None


def main() -> None:
    import __spark_entry__ as e
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = connect(sf), e.oracle_sql(), []
    for name, fn in e.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            types = [t for _, t in df.dtypes]
            got = df.toPandas()
            took = time.time() - start
            if name not in oracles:
                note = f"rows {len(got)} (no SQL)"
            else:
                start = time.time()
                note = differences(got, con.execute(oracles[name]).df()) or f"ok rows {len(got)}"
                note += f" [sql {time.time() - start:.1f}s]"
                if not note.startswith("ok"):
                    failed.append(name)
        except Exception as ex:  # report and go on
            took, note = time.time() - start, f"ERROR {type(ex).__name__}: {str(ex)[:600]}"
            failed.append(name)
        print(f"{name:28s} {took:6.1f}s {note}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
