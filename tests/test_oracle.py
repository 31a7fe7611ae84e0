"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import datetime
import math
import os

import duckdb
import pandas as pd
import pytest

from tidewell import registry

DATA = "/root/testdata/sf0.001"
SLOW = {"gbt_aipw_bootstrap"}  # 300 fits


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(pd.Timestamp(value))
    if hasattr(value, "item"):
        value = value.item()
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def rows(frame: pd.DataFrame):
    names = sorted(frame.columns)
    return sorted([tuple(plain(v) for v in row) for row in frame[names].itertuples(index=False)], key=repr)


def close(a, b) -> bool:
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-6 * max(1.0, abs(a)))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    ours, theirs = registry.QUERIES[name](spark, DATA).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    left, right = rows(ours), rows(theirs)
    assert len(left) == len(right)
    for a, b in zip(left, right, strict=True):
        assert all(close(x, y) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - SLOW))
def test_rows_only(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
