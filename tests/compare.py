"""Rows of a Spark query and of DuckDB SQL in one comparable form."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        f = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{f + '/*.parquet' if os.path.isdir(f) else f}')")
    return con


def plain(x):
    if x is None or pd.isna(x):
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool":
        return int(x)
    if isinstance(x, float) or hasattr(x, "dtype") and x.dtype.kind == "f":
        return round(float(x), 6)
    if hasattr(x, "dtype"):
        return x.item()
    return x


def rows(df) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted((tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False)), key=repr)
