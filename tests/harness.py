"""Comparison of Spark results with their SQL twins."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    """A value in a form both engines share."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int,)):
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.9g}"
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, df.collect())


def duck_rows(con, sql: str):
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    return sorted(columns), rows_of(columns, cur.fetchall())


def types(df, con, sql: str) -> list[str]:
    """Columns whose type family differs between the engines."""
    family = {
        "int": "i", "bigint": "i", "smallint": "i", "tinyint": "i", "integer": "i", "hugeint": "HUGE",
        "double": "f", "float": "f", "string": "s", "varchar": "s", "boolean": "b",
        "timestamp": "t", "date": "d", "timestamp_ntz": "t",
    }
    cur = con.execute(f"DESCRIBE {sql}").fetchall()
    duck_types = {r[0]: r[1].lower() for r in cur}
    out = []
    for name, kind in df.dtypes:
        a, b = family.get(kind, kind), family.get(duck_types.get(name, "?"), duck_types.get(name))
        if a != b:
            out.append(f"{name}: {kind} / {duck_types.get(name)}")
    return out
