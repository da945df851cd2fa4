"""Spark's rows of a query against those of its SQL."""

import math
from pathlib import Path

import duckdb
import pandas as pd


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(folder).iterdir()):
        con.execute(f"CREATE VIEW {p.name.split('.')[0]} AS SELECT * FROM '{p}'")
    return con


def plain(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, float) or type(v).__name__.startswith("float"):
        return f"{float(v):.6g}"
    if v is pd.NaT or v is pd.NA:
        return "NULL"
    return str(v)


def rows(df: pd.DataFrame) -> list[str]:
    return sorted("|".join(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def compare(spark_df, con, sql: str) -> None:
    a, b = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
