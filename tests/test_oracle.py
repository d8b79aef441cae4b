"""Every registered query against its SQL on the smallest tables (sf0.01 in the driver's own check)."""

import os

import pytest
from check import compare, connect

from basketry.plans import oracle_sql, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    ok, message = compare(spark, con, SF_DIR, queries()[name], oracle_sql().get(name))
    assert ok, message
