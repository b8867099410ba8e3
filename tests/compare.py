"""Order-insensitive comparison of a Spark result with its DuckDB oracle."""

from __future__ import annotations

import duckdb
import pandas as pd

from taxon.plans.views import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    text = df.map(lambda x: "<null>" if x is None or x is pd.NA or x != x else (f"{x + 0.0:.6f}" if isinstance(x, float) else str(x)))
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def differences(spark_df: pd.DataFrame, oracle_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(oracle_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(oracle_df.columns)}"
    if len(spark_df) != len(oracle_df):
        return f"rows {len(spark_df)} != {len(oracle_df)}"
    a, b = canonical(spark_df), canonical(oracle_df)
    wrong = (a != b).any(axis=1)
    if wrong.any():
        i = wrong.idxmax()
        return f"{int(wrong.sum())} rows differ, first:\n  {a.loc[i].to_dict()}\n  {b.loc[i].to_dict()}"[:1500]
    return None
