"""Every registered query against its SQL on the smallest tables."""

import os

import oracle
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("SYMLOOM_TEST_DATA", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.database(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name not in SQL:
        assert QUERIES[name](spark, FOLDER).columns
        return
    have, want = oracle.compare(spark, con, FOLDER, QUERIES[name], SQL[name])
    assert have[0] == want[0]
    assert have[1] == want[1]


def test_entry(spark):
    top = entry.entry(spark)
    assert top.columns == ["cls", "full", "n", "files"]
    assert top.count() == 20


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
