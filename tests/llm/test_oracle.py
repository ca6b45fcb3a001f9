"""Queries that SQL can state, against DuckDB on the same tables."""

import pytest

import __spark_entry__
from geoaffinity.llm.queries import LLM_ORACLE_SQL, LLM_QUERIES
from tests.oracle_check import differences, duck

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(LLM_ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert differences(LLM_QUERIES[name](spark, FOLDER), duck(FOLDER), LLM_ORACLE_SQL[name]) is None


def test_every_operator_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
