"""Every registered query against its SQL in DuckDB, on the smallest tables; those without SQL must run."""

import math
import os

import duckdb
import pytest

from tapespark import plans

SF = "/root/testdata/sf0.001"


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(norm(x) for x in value)
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(norm(r[c]) for c in columns) for r in df.collect()]
    if name not in plans.ORACLE_SQL:
        assert columns
        return
    result = duck.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(norm(r[names.index(c)]) for c in columns) for r in result.fetchall()]
    assert sorted(rows, key=str) == sorted(want, key=str)
