"""Every registered query against its SQL on the smallest driver tables."""

import datetime
import decimal
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry_module  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return value + 0.0
    return value.isoformat() if isinstance(value, datetime.date) else value


def rows_of(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query(spark, duck, name):
    df = entry_module.queries()[name](spark, FOLDER)
    got = df.collect()
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, got) == rows_of(want.columns, want.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_inventory_row_has_a_query():
    wanted = {f"{letter}{i}" for letter, n in dict(s=21, c=24, d=10, b=15, f=14, v=9, j=20, a=44, w=9, p=9, t=1).items() for i in range(1, n + 1)}
    have = {name.split("_")[0] for name in entry_module.queries()}
    assert not wanted - have


def test_no_oversized_plans(spark):
    """No cartesian products anywhere in the flagship plans."""
    for name in ("b7_running_balance", "a3_analysis_raw", "a10_exposure", "w3_mismatch_context", "j7_customer_lineage"):
        plan = entry_module.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
