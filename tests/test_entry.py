"""The entry point's contract, and every SQL-backed core query against DuckDB on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tideloom.plans import control_queries, general_queries, reference_queries

SF = "/root/testdata/sf0.001"
CORE = {**general_queries.SQL, **reference_queries.SQL, **control_queries.SQL}


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CORE) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["post_id", "status", "margin"] and df.count() > 0


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.astimezone(datetime.timezone.utc).replace(tzinfo=None).isoformat() if v.tzinfo else v.isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(v[i]) for i in order)) for v in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(CORE))
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rel = duck.execute(CORE[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, rel.fetchall())
