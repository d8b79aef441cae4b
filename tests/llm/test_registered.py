"""The registered queries: names, and SQL beside Spark where SQL can express one."""

import pytest
from check import compare, connect

import __spark_entry__ as entry
from basketry.llm.queries import oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert [n.split("_")[0] for n in queries()] == [f"op{i}" for i in range(1, 14)]
    assert {*queries(), "pipeline"} <= set(entry.queries()) and set(oracle_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_equals_its_sql(spark, name):
    ok, message = compare(spark, connect(SF_DIR), SF_DIR, queries()[name], oracle_sql()[name])
    assert ok, message
