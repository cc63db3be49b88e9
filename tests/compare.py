"""Spark answer against SQL answer, row for row."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def open_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return ("", "null")
    if isinstance(value, pd.Timestamp):
        return ("t", value.value if value.unit == "ns" else value.as_unit("ns").value)
    if hasattr(value, "item"):
        value = value.item()
    return (type(value).__name__, value)


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(_cell(v) for v in row) for row in pdf.itertuples(index=False))


def kinds(pdf: pd.DataFrame) -> dict[str, str]:
    return {c: str(pdf[c].dtype).split("[")[0] for c in sorted(pdf.columns)}


def difference(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    ours, theirs = spark_df.toPandas(), con.sql(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} != {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    a, b = _rows(ours), _rows(theirs)
    for x, y in zip(a, b):
        if x != y:
            return f"{sum(p != q for p, q in zip(a, b))} rows differ, first {x} != {y}"
    if kinds(ours) != kinds(theirs):
        return f"types {kinds(ours)} != {kinds(theirs)}"
    return None
