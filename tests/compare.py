"""Compares a query with its SQL on the same tables."""

import glob
import os

import duckdb
import pandas as pd


def connected(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(x: object) -> object:
    """A value as it is compared: times to the second, and whole floats as the integers that nulls made them from."""
    if hasattr(x, "year"):
        return str(x)[:19]
    return int(x) if isinstance(x, float) and x.is_integer() else x


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    values = frame.astype(object).where(frame.notna(), None)
    return sorted(str(tuple(plain(x) for x in r)) for r in values.itertuples(index=False, name=None))


def same(ours: pd.DataFrame, sql: str, sf_dir: str) -> None:
    theirs = connected(sf_dir).sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = rows(ours), rows(theirs)
    assert len(a) == len(b)
    assert a == b
