"""Runs a query and its SQL on the same folder and tells how they differ."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date",
          "BOOLEAN": "boolean", "FLOAT": "float", "TIMESTAMP": "timestamp"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, decimal.Decimal):
        return ("decimal", value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return repr(value)


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both give the same columns and rows."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns differ: spark {sorted(df.columns)}, sql {sorted(names)}"
    order = sorted(names)
    theirs_types = {d[0]: _TYPES.get(str(d[1]), str(d[1])) for d in result.description}
    ours_types = {n: k.replace("_ntz", "") for n, k in df.dtypes}
    wrong = {n: (ours_types[n], theirs_types[n]) for n in order if ours_types[n] != theirs_types[n]}
    if wrong:
        return f"types differ (spark, sql): {wrong}"
    theirs = Counter(tuple((type(v).__name__, _plain(v)) for v in (row[names.index(n)] for n in order))
                     for row in result.fetchall())
    ours = Counter(tuple((type(v).__name__, _plain(v)) for v in row) for row in df.select(*order).collect())
    if ours == theirs:
        return None
    return (f"rows: spark {sum(ours.values())}, sql {sum(theirs.values())}; {order}; "
            f"only spark {list((ours - theirs).items())[:3]}; only sql {list((theirs - ours).items())[:3]}")
