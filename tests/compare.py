"""Runs registered queries beside their SQL and compares columns, types' kinds and values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

FOLDER = "/root/testdata/sf0.01"


def tables(folder=FOLDER):
    con = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value + 0.0:.6f}"
    return str(value)


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted([tuple(_plain(r[i]) for i in order) for r in rows])


def spark_result(df):
    return _sorted_rows(df.columns, [tuple(r) for r in df.collect()])


def sql_result(con, sql):
    found = con.execute(sql)
    return _sorted_rows([d[0] for d in found.description], found.fetchall())


def kinds(df, con, sql):
    """Spark and SQL column types under common names, for those that differ."""
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
    ours = {c: names.get(t, t) for c, t in df.dtypes}
    theirs = {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}
    return {c: (ours[c], theirs.get(c)) for c in ours if ours[c] != theirs.get(c)}
