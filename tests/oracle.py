"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def rows(frame) -> list[str]:
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        if hasattr(v, "item"):
            v = v.item()
        return round(v, 9) if isinstance(v, float) else v

    columns = sorted(frame.columns)
    return sorted(repr([plain(v) for v in r]) for r in frame[columns].astype(object).values.tolist())


def connection(folder: str):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def assert_same(spark, folder: str, run, sql: str) -> None:
    got, want = run(spark, folder).toPandas(), connection(folder).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
