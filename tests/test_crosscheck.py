"""Every named query against its SQL in DuckDB."""

import os

import pytest

import __spark_entry__ as entry
from crosscheck import compare, connect
from tallyframe import catalog

FOLDER = os.environ.get("CROSSCHECK_SF_DIR", "/root/testdata/sf0.001")
catalog.load()
SQLS = catalog.CROSS_CHECKS


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    assert name in SQLS
    assert compare(spark, con, FOLDER, catalog.QUERIES[name], SQLS[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 1
