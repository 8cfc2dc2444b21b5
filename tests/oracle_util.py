"""Side-by-side check of a Spark query against its DuckDB oracle SQL."""

from __future__ import annotations

import hashlib
import math

import duckdb
import pandas as pd

from behaviorlens.sources.fixtures import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v == int(v) and abs(v) < 2**53:
            return int(v)
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def frame_digest(df: pd.DataFrame) -> tuple[int, list[str], str]:
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(_norm(r[c]) for c in cols)) for _, r in df.iterrows())
    h = hashlib.sha256("\n".join(rows).encode()).hexdigest()
    return len(df), cols, h


def compare(spark, con, name: str, query, sql: str, sf_dir: str):
    sdf = query(spark, sf_dir).toPandas()
    odf = con.execute(sql).df()
    a = frame_digest(sdf)
    b = frame_digest(odf)
    return a, b, sdf, odf
