"""Every core query with SQL gives what DuckDB gives over the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from eventloom.plans import problem_queries, reference_queries

from conftest import SF

duckdb = pytest.importorskip("duckdb")
CORE = {**problem_queries.oracle_sql(), **reference_queries.oracle_sql()}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(CORE))
def test_same_as_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(CORE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want


def test_entry_is_stable(spark):
    df = entry.entry(spark)
    assert df.columns == ["category", "rank", "user_id", "score", "n_events"] and df.count() > 0
