"""Runs queries in Spark and their SQL in DuckDB on the same tables and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def duck(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    rel = con.sql(sql)
    return list(rel.columns), rel.fetchall()


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if v is None:
            return "~null"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            v = float(v)
            return "nan" if math.isnan(v) else f"{v:.6f}"
        return str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "FLOAT": "float"}


def types(sf_dir: str, sql: str) -> dict[str, str]:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    rel = con.sql(sql)
    return {c: KINDS.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types, strict=True)}


def differences(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same bag of rows."""
    df = query(spark, sf_dir)
    mine, names = canonical(df.columns, [tuple(r) for r in df.collect()]), sorted(df.columns)
    columns, rows = duck(sf_dir, sql)
    theirs = canonical(columns, rows)
    if names != sorted(columns):
        return f"columns {names} and {sorted(columns)}"
    if (want := types(sf_dir, sql)) != (have := dict(df.dtypes)):
        return f"types {[(c, have[c], want[c]) for c in want if have[c] != want[c]]}"
    if mine == theirs:
        return ""
    a, b = set(mine) - set(theirs), set(theirs) - set(mine)
    return f"{len(mine)} and {len(theirs)} rows; only Spark: {[x for x in a][:2]}; only SQL: {[x for x in b][:2]}"
