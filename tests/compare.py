"""Comparison of a Spark result with DuckDB's, without regard to order."""

import glob
import os

import duckdb
import pandas as pd


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if x is None or (not isinstance(x, (list, dict)) and not hasattr(x, "__len__") and pd.isna(x)):
            return "~"
        if isinstance(x, bool) or type(x).__name__ == "bool":
            return str(bool(x))
        if isinstance(x, (int, float)) or hasattr(x, "dtype") and not hasattr(x, "__len__"):
            return f"{round(float(x), 6) + 0.0:.6f}"
        return str(list(x)) if hasattr(x, "__len__") and not isinstance(x, (str, bytes, dict)) else str(x)

    return sorted(tuple(one(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False))
