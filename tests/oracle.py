"""Runs a query and its DuckDB twin over the same tables and compares rows."""
from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "fiu":
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns), na_position="last").reset_index(drop=True)


def difference(spark_df, sql: str, con) -> str:
    """Empty if both give the same rows; floats may differ by one in the sixth place."""
    a, b = ordered(spark_df.toPandas()), ordered(con.execute(sql).fetchdf())
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} {list(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} {len(b)}"
    # near-equal doubles may sort apart, so rows are matched on the other columns first
    exact = [c for c in a.columns if a[c].dtype.kind not in "f"] + [c for c in a.columns if a[c].dtype.kind == "f"]
    a, b = (x.sort_values(exact).reset_index(drop=True) for x in (a, b))
    for c in a.columns:
        x, y = a[c], b[c]
        if x.dtype.kind == "f":
            bad = ~(((x - y).abs() <= 2e-6) | (x.isna() & y.isna()))
        else:
            bad = ~((x == y) | (x.isna() & y.isna()))
        if bad.any():
            i = bad.idxmax()
            return f"{c}: {int(bad.sum())} differ, as {x[i]!r} {y[i]!r}"
    return ""
