"""The subpackage's queries on empty tables and on rows of nulls."""

import pytest
from conftest import edge_tables

from loomdex.llm import queries as llm


@pytest.mark.parametrize("kind", ["empty", "null"])
def test_queries(spark, tmp_path, kind):
    d = edge_tables(spark, tmp_path, kind)
    rows = {name: f(spark, d).count() for name, f in llm.queries().items()}
    # one row for every document, whatever it holds
    every = {"p1_clean", "p8_ids"} if kind == "null" else set()
    assert rows == {name: 2 if name in every else 0 for name in rows}
