"""Holds what Spark returns against what DuckDB returns for the same tables."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def _cell(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if hasattr(v, "item") and not getattr(v, "shape", ()):
        v = v.item()
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{v:.9g}" if isinstance(v, float) or abs(v) < 10**9 else str(v)
    return str(v.tolist()) if hasattr(v, "tolist") else str(v)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(tuple(map(_cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def same(spark_df: pd.DataFrame, duck_df: pd.DataFrame) -> None:
    assert sorted(spark_df.columns) == sorted(duck_df.columns)
    assert rows(spark_df) == rows(duck_df)
