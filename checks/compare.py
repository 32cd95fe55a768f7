"""Run a check on Spark and its SQL on DuckDB and compare all rows."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os

import duckdb

_KINDS = {
    "tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "int", "hugeint": "hugeint",
    "double": "float", "float": "float", "string": "text", "varchar": "text", "boolean": "bool", "date": "date",
    "timestamp": "time", "timestamp_ntz": "time",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _sortable(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def compare(df, con, sql: str) -> list[str]:
    """Differences in columns, types or rows; empty when both agree."""
    names = sorted(df.columns)
    spark_types = {n: _KINDS.get(t, t) for n, t in df.dtypes}
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    sql_types = {r[0]: _KINDS.get(r[1].lower(), r[1].lower()) for r in described}
    if sorted(sql_types) != names:
        return [f"columns differ: {sorted(set(names) ^ set(sql_types))}"]
    problems = [f"{n}: {spark_types[n]} / {sql_types[n]}" for n in names if spark_types[n] != sql_types[n]]
    if len(names) != len(set(names)):
        problems.append("repeated column names")
    listed = ", ".join(f'"{n}"' for n in names)
    expected = sorted((tuple(map(_plain, r)) for r in con.execute(f"SELECT {listed} FROM ({sql})").fetchall()), key=_sortable)
    actual = sorted((tuple(map(_plain, r)) for r in df.select(*names).collect()), key=_sortable)
    if len(expected) != len(actual):
        problems.append(f"{len(actual)} rows, expected {len(expected)}")
    for a, e in zip(actual, expected):
        if a != e:
            pairs = [(n, x, y) for n, x, y in zip(names, a, e) if x != y]
            problems.append(f"first difference: {pairs} in {dict(zip(names, a))}")
            break
    if not expected:
        problems.append("no rows to compare")
    return problems
