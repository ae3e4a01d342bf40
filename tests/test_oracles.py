"""Every registered query against its SQL twin at the smallest scale factor."""

import os

import pytest

import __spark_entry__ as entry
from tests import compare

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    columns, got = compare.actual(entry.queries()[name](spark, SF_DIR))
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert sum(got.values()) > 0
        return
    want_columns, want = compare.expected(con, sql)
    assert columns == want_columns
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["build_catalog", "catalog_warnings", "find_resumable", "health_report"])
def test_ids_that_repeat_past_a_million_keys(spark, workdir, name):
    con = compare.duck(SF_DIR)
    con.execute("CREATE VIEW more AS SELECT o.* REPLACE (o_orderkey + i * 1000000 AS o_orderkey) FROM orders o, range(4) r(i) WHERE o_orderkey % 2 = 0 OR i < 2")
    con.execute(f"COPY more TO '{workdir}/orders.parquet'")
    for table in ("events", "customer"):
        con.execute(f"COPY {table} TO '{workdir}/{table}.parquet'")
    columns, got = compare.actual(entry.queries()[name](spark, workdir))
    assert (columns, got) == compare.expected(compare.duck(workdir), entry.oracle_sql()[name])
