"""Each query with SQL against that SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("LEADLOOM_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def rows(values, names: list[str]) -> list[str]:
    """Rows as text, columns by name; Python values on both sides, as pandas would turn integers with nulls into floats."""
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order]) for r in values)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, DATA)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), names)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_topk_is_planned_as_such(spark):
    plan = entry.queries()["lead_score_topk"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_scan_reads_only_what_it_needs(spark):
    plan = entry.queries()["phone_keys"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<lead_id:bigint,phone:string>" in plan
