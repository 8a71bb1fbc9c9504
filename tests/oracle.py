"""Compares a registered query with its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if hasattr(x, "as_integer_ratio") and not isinstance(x, (int, bool)):
        return round(float(x), 6)
    return x


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differs(spark, sf_dir: str, query, sql: str) -> str:
    """Empty where the results are equal, else what differs."""
    con = duckdb.connect()
    for t in TABLES.split():
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = query(spark, sf_dir)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    a, b = rows_of(got.columns, got.collect()), rows_of(names, found.fetchall())
    if sorted(got.columns) != sorted(names):
        return f"columns {sorted(got.columns)} and {sorted(names)}"
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}"
    for x, y in zip(a, b, strict=True):
        if x != y and not all(p == q or (isinstance(p, float) and isinstance(q, (int, float)) and math.isclose(p, q, rel_tol=1e-6, abs_tol=1e-6)) for p, q in zip(x, y, strict=True)):
            return f"{x} and {y}"
    return ""
