"""Runs a query on Spark and its SQL in the check engine, and compares the rows."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def canonical(rows, names) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(x):
        return "nan" if isinstance(x, float) and math.isnan(x) else x

    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def spark_rows(df: DataFrame) -> tuple[list[str], list]:
    return df.columns, canonical([tuple(r) for r in df.collect()], df.columns)


def sql_rows(db: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list]:
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    return names, canonical(result.fetchall(), names)


def difference(df: DataFrame, db, sql: str) -> str | None:
    """None if both sides agree, else what differs."""
    names, got = spark_rows(df)
    want_names, want = sql_rows(db, sql)
    if sorted(names) != sorted(want_names):
        return f"columns {sorted(names)} and {sorted(want_names)}"
    if got != want:
        extra = [r for r in got if r not in want][:2] if len(got) < 50_000 else "?"
        missing = [r for r in want if r not in got][:2] if len(want) < 50_000 else "?"
        return f"{len(got)} rows and {len(want)}; only Spark: {str(extra)[:600]}; only SQL: {str(missing)[:600]}"
    return None


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
