"""Every query with SQL gives the same rows as a second engine on the smallest tables; all others run."""

import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
OWN = [n for n in __spark_entry__.queries() if n != "pipeline" and not n.startswith("op")]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f") if v else "0"
    if isinstance(v, float):
        return repr(round(v, 6))
    return str(v)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    df = __spark_entry__.queries()[name](spark, SF)
    rows = df.collect()
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(str([plain(dict(zip(columns, r, strict=True))[c]) for c in sorted(columns)]) for r in result.fetchall())
    assert sorted(str([plain(r[c]) for c in sorted(columns)]) for r in rows) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
