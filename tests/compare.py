"""Hold a query's rows against those of its SQL in DuckDB on the same tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    with duckdb.connect() as db:
        for path in Path(sf_dir).glob("*.parquet"):
            db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
        found = db.execute(sql)
        columns = [c[0] for c in found.description]
        return sorted(columns), rows_of(columns, found.fetchall())


def assert_same(spark, query, sql: str, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    columns, expected = sql_rows(sql, sf_dir)
    assert sorted(df.columns) == columns
    got = rows_of(df.columns, df.collect())
    assert got == expected, f"only in Spark: {list((got - expected).items())[:3]}; only in SQL: {list((expected - got).items())[:3]}"
