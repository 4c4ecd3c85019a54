"""Comparison of a query with its SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame) -> list[tuple]:
    cols = sorted(frame.columns)
    value = lambda v: None if v is None or v != v else (float(v) if isinstance(v, float) else v)
    return sorted((tuple(value(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False)), key=repr)


def expected(sql: str, sf: str):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c.sql(sql).df()


def agree(query, sql: str, spark, sf: str) -> None:
    got, want = query(spark, sf).toPandas(), expected(sql, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
