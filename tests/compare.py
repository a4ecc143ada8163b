"""Rows of a query beside the rows of its SQL."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from docketlens.plans.domain import TABLES


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def sql_rows(sql: str, sf: str, columns: list[str]) -> list[tuple]:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    return sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)


def spark_rows(frame) -> tuple[list[str], list[tuple]]:
    columns = sorted(frame.columns)
    rows = frame.select(*[f"`{c}`" for c in columns]).collect()
    return columns, sorted((tuple(plain(v) for v in r) for r in rows), key=repr)
