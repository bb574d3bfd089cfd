"""Spark results against DuckDB's, row by row."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _text(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return "null"
    return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)  # integers with nulls among them


def _plain(p: pd.DataFrame) -> pd.DataFrame:
    p = p[sorted(p.columns)].copy()
    for c in p.columns:
        if p[c].dtype.kind == "f":
            p[c] = p[c].map(lambda v: "null" if pd.isna(v) else f"{v:.9g}")
        else:
            p[c] = p[c].map(_text)
    return p.sort_values(list(p.columns)).reset_index(drop=True)


def same(spark_df, sql: str, sf_dir: str) -> None:
    a, b = _plain(spark_df.toPandas()), _plain(duck(sf_dir).sql(sql).df())
    assert list(a.columns) == list(b.columns)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
