"""Runs a registered query and its SQL on the same tables and compares their rows."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def _exact(v) -> bool:
    return not isinstance(v, (float, Decimal))


def _key(row: tuple) -> tuple:
    """Exact values first, so that rounding can't change the order of rows that these tell apart."""
    plain = [None if isinstance(v, float) and math.isnan(v) else v for v in row]
    return repr([v for v in plain if _exact(v)]), [math.inf if v is None else v for v in plain if not _exact(v) or v is None]


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(r[k] for k in order) for r in rows), key=_key)


def difference(spark, con, sf_dir: str, run, sql: str) -> str:
    """What differs, or an empty text: exact values must be equal, floats to six digits."""
    df = run(spark, sf_dir)
    found = rows_of(df.columns, df.collect())
    rel = con.sql(sql)
    wanted = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {df.columns} and {rel.columns}"
    if len(found) != len(wanted):
        return f"{len(found)} rows, SQL has {len(wanted)}"
    odd = [(a, b) for a, b in zip(found, wanted, strict=True) if not all(map(_same, a, b))]
    return f"{len(odd)} rows differ, such as {odd[:2]}" if odd else ""


def _same(x, y) -> bool:
    if x is None or y is None or isinstance(x, bool) or isinstance(y, bool) or not (isinstance(x, (int, float, Decimal)) and isinstance(y, (int, float, Decimal))):
        return x is y or x == y
    return math.isnan(x) and math.isnan(y) or math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-7)
