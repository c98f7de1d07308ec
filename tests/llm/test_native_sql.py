"""Operators that SQL can express, against DuckDB."""

import pytest

from compare import connect, same
from tracewell.llm.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_duckdb(spark, name):
    same(queries()[name](spark, SF), connect(SF), oracle_sql()[name])
