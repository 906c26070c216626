"""Compare a Spark result with DuckDB's, regardless of row and column order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return bytes(v) if isinstance(v, bytearray) else v


def rows_of(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def differences(df, con, sql: str) -> str:
    """Empty where both agree, else what differs."""
    rel = con.execute(sql)
    names, theirs = [d[0] for d in rel.description], rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    ours = rows_of(df.columns, df.collect())
    theirs = rows_of(names, theirs)
    if ours == theirs:
        return ""
    a, b = set(ours), set(theirs)
    return f"{len(ours)} and {len(theirs)} rows; only Spark: {sorted(a - b)[:3]}; only DuckDB: {sorted(b - a)[:3]}"
