"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from weftline import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(spark, name, query, sql, data=DATA):
    con = duckdb.connect()
    for t in TABLES:
        if (data / f"{t}.parquet").exists():
            con.sql(f"create view {t} as select * from read_parquet('{data / t}.parquet')")
    got = query(spark, str(data))
    want = con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else f"{v:.12g}" if isinstance(v, float) else str(v)
    a = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    b = sorted(tuple(plain(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())
    assert a == b, name


pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, name, catalog.QUERIES[name], catalog.ORACLES[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["word_count", "project_orders", "sum_quantity_by_supplier"])
def test_scans_read_only_what_they_need(spark, name):
    plan = catalog.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema: struct<") :].split(">")[0]
    assert schema.count(":") <= 3 + schema.count("::")
