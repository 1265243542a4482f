"""Every registered query against its oracle SQL on the smallest tables."""

import decimal
import math
from collections import Counter

import pytest

duckdb = pytest.importorskip("duckdb")

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from docvet.plans.inputs import BASE_TABLES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, float):
        return "nan" if math.isnan(value) else int(value) if value == int(value) else round(value, 6)
    return value


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, oracle, name):
    df = queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    spark.catalog.clearCache()
    sql = oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = oracle.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, result.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0
