"""The general problems' queries on empty tables and on rows of nulls."""

import pytest
from conftest import edge_tables

from loomdex.plans import problems


@pytest.mark.parametrize("kind", ["empty", "null"])
def test_problem_queries(spark, tmp_path, kind):
    d = edge_tables(spark, tmp_path, kind)
    assert {name: f(spark, d).count() for name, f in problems.QUERIES.items()} == dict.fromkeys(problems.QUERIES, 0)
