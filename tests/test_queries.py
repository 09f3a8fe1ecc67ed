"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__
from checks.run import compare, connect

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()
SLOW = {"compare_before_after"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], ORACLES.get(name)) == ""


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 4
