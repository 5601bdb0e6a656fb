"""Runs a registered query on Spark and its check SQL on DuckDB and compares whole results."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v) or math.isinf(v):
            return str(v)
        return repr(round(v, 9) + 0.0)
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(con, df, sql):
    """None when equal, else a short description of the difference."""
    spark_cols, spark_rows = rows_of(df.columns, df.collect())
    rel = con.sql(sql)
    duck_cols, duck_rows = rows_of(list(rel.columns), rel.fetchall())
    if spark_cols != duck_cols:
        return f"columns {spark_cols} != {duck_cols}"
    kinds = lambda rows: [{type(r[i]).__name__ for r in rows if r[i] is not None} for i in range(len(spark_cols))]
    if len(spark_rows) != len(duck_rows):
        a, b = set(spark_rows), set(duck_rows)
        return f"rows {len(spark_rows)} != {len(duck_rows)}; only spark {sorted(a - b, key=repr)[:2]}; only duck {sorted(b - a, key=repr)[:2]}"
    if spark_rows != duck_rows:
        a, b = set(spark_rows), set(duck_rows)
        return f"values differ in {len(a - b)} of {len(a)}: {sorted(a - b, key=repr)[:2]} vs {sorted(b - a, key=repr)[:2]}"
    if kinds(spark_rows) != kinds(duck_rows):
        return f"types {kinds(spark_rows)} != {kinds(duck_rows)}"
    return None
