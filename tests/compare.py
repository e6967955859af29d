"""Run a registered query and its SQL on the same tables and compare the results."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{root}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


SPARK_KIND = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
              "date": "DATE", "boolean": "BOOLEAN"}


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime) and value.time() == datetime.time(0):
        return value.date()
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a DataFrame and a SQL result; empty if nothing does.

    Values must be equal, not close; only the order of rows is free.
    """
    out = []
    names = sorted(df.columns)
    result = con.execute(sql)
    sql_names = [d[0] for d in result.description]
    if names != sorted(sql_names):
        return [f"columns {names} != {sorted(sql_names)}"]
    sql_kinds = {d[0]: str(d[1]) for d in result.description}
    for f in df.schema:
        want = SPARK_KIND.get(f.dataType.simpleString(), f.dataType.simpleString())
        if want != sql_kinds[f.name]:
            out.append(f"type of {f.name}: {want} != {sql_kinds[f.name]}")
    order = [sql_names.index(n) for n in names]
    theirs = sorted(([_plain(r[i]) for i in order] for r in result.fetchall()), key=_key)
    ours = sorted(([_plain(r[n]) for n in names] for r in df.collect()), key=_key)
    if len(ours) != len(theirs):
        out.append(f"rows {len(ours)} != {len(theirs)}")
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        a, b = bad[0]
        cells = [(n, x, y) for n, x, y in zip(names, a, b) if x != y]
        worst = max((abs(x - y) for a, b in bad for x, y in zip(a, b)
                     if isinstance(x, float) and isinstance(y, float)
                     and not math.isnan(x - y)), default=0)
        out.append(f"{len(bad)} rows differ, first: {cells[:4]}, largest gap {worst}")
    return out
