"""Compares a query with its SQL in DuckDB, rows in any order, columns by name."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return db


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[k] for k in order) for r in rows), key=repr)


def assert_same(df, sql: str, folder: str) -> int:
    db = database(folder)
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    left, right = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, cursor.fetchall())
    assert left == right
    return len(left)
