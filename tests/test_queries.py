"""Every library query against its SQL, on the smallest test tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__  # noqa: F401  registers the queries
from factlens.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return repr(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    found = db.sql(ORACLES[name])
    columns = found.columns
    assert sorted(columns) == sorted(df.columns)
    a = sorted(tuple(_norm(r[k]) for k in sorted(columns)) for r in rows)
    b = sorted(tuple(_norm(r[columns.index(k)]) for k in sorted(columns)) for r in found.fetchall())
    assert a == b


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 8


@pytest.mark.parametrize("name", ["format_bytes", "int_special_form"])
def test_orders_with_large_keys(spark, tmp_path, name):
    """Sizes over a terabyte, timestamps after the year 9999."""
    c = duckdb.connect()
    c.sql(f"COPY (SELECT * REPLACE (o_orderkey * 6151 AS o_orderkey) FROM '{SF}/orders.parquet') TO '{tmp_path}/orders.parquet'")
    c.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    df, found = QUERIES[name](spark, str(tmp_path)), c.sql(ORACLES[name])
    columns = found.columns
    a = sorted(tuple(_norm(r[k]) for k in columns) for r in df.collect())
    assert a == sorted(tuple(map(_norm, r)) for r in found.fetchall())
