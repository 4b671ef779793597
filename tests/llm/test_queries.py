"""Every query of the subpackage over whole tables: against DuckDB where SQL can state it."""

import pytest
from conftest import DATA, same_rows

from loomdex.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query(spark, duck, name):
    same_rows(llm.queries()[name](spark, DATA), duck.sql(llm.oracle_sql()[name]))


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_rows_only(spark, name):
    assert llm.queries()[name](spark, DATA).count() > 0


def test_registered():
    import __spark_entry__

    assert set(llm.queries()) <= set(__spark_entry__.queries())


def test_clean_text_of_category_entries(spark, tmp_path):
    spark.createDataFrame([(1, "<b>x</b>"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pages = [(7, ["[[Category:A of B]]", "Plain", None]), (7, ["[[Category:A of B]]", "C<br />"]), (8, None), (8, ["Plain"]), (None, ["Q"])]
    spark.createDataFrame(pages, "id long, categories array<string>").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.tbl, r.rec_id, r.entry or "", r.clean_text) for r in llm.queries()["p1_clean"](spark, str(tmp_path)).collect())
    assert got == [("documents", 1, "", "x"), ("documents", 2, "", None), ("pages", 7, "C<br />", "C"), ("pages", 7, "Plain", "Plain"), ("pages", 7, "[[Category:A of B]]", "A of B"), ("pages", 8, "Plain", "Plain")]
