"""Compare a query with its SQL in DuckDB: same columns, same rows, whatever their order."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(files):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{files}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    relation = con.sql(sql)
    ours, theirs = spark_df.columns, relation.columns
    if sorted(ours) != sorted(theirs):
        return f"columns {sorted(ours)} and {sorted(theirs)}"
    a = rows_of(ours, [tuple(r) for r in spark_df.collect()])
    b = rows_of(theirs, relation.fetchall())
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} rows, first {bad[0]}" if bad else None
