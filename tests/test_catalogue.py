"""Every query with SQL gives the rows of DuckDB over the same tables; the others run."""

import math

import duckdb
import pytest

from trafficlens.plans import catalogue
from trafficlens.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value)
    return f"{float(value):.9g}" if isinstance(value, (int, float)) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    rows = got.collect()
    assert rows or name == "backend_validation"  # the smallest tables have no two backends of one id
    if name in catalogue.ORACLE_SQL:
        want = duck.sql(catalogue.ORACLE_SQL[name])
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        order = [want.columns.index(c) for c in columns]
        a = sorted(tuple(plain(r[c]) for c in columns) for r in rows)
        b = sorted(tuple(plain(r[k]) for k in order) for r in want.fetchall())
        assert a == b
