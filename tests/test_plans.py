"""Plans that must hold at scale: what is pushed down, what is shuffled, what reaches Python."""

import re

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from loomdex.functions import text as tx
from loomdex.operators import index, search
from loomdex.plans import problems, search_queries
from loomdex.session import table


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    shown = plan(problems.page_references(table(spark, DATA, "pages")))
    schema = re.search(r"ReadSchema: struct<(.*)", shown)[1]
    assert "IsNotNull(id)" in shown and "categories" not in schema and "title" not in schema


def test_tokens_stay_in_the_jvm(spark):
    shown = plan(search_queries.tokenize_en(spark, DATA))
    assert "Python" not in shown and "ArrowEval" not in shown


def test_postings_shuffle_once_by_term_and_document(spark):
    docs = table(spark, DATA, "documents").select("doc_id", "text")
    shown = plan(index.postings(docs, tx.tokens_en(tx.lines(F.col("text")))))
    assert shown.count("Exchange hashpartitioning") == 1 and re.search(r"hashpartitioning\(term#\d+, doc_id#\d+L?", shown)


def test_query_terms_are_broadcast_against_postings(spark):
    weighted = spark.createDataFrame([("a", 1, [0], 1.0, 0.5)], "term string, doc_id long, lc array<int>, tf double, tf_idf double")
    vectors = spark.createDataFrame([(0, "a", 1.0, 1.0, [("a", "b")])], "query_id long, term string, weight double, length double, bigrams array<struct<a:string,b:string>>")
    shown = plan(search.candidates(vectors, weighted))
    assert "BroadcastHashJoin" in shown and "SortMergeJoin" not in shown and shown.count("Exchange hashpartitioning") <= 2


def test_one_search_joins_nothing(spark):
    stored = spark.createDataFrame([("a", 1, [0], 0.5, 1.0, 0.1)], "term string, doc_id long, lc array<int>, tf_idf double, norm double, rank double")
    shown = plan(search.best_of_query(stored, ["a", "b"], {"a": 1.0, "b": 1.0}, 5))
    assert "Join" not in shown and shown.count("Exchange hashpartitioning") == 1 and "TakeOrderedAndProject" in shown


@pytest.mark.parametrize("k", [3])
def test_top_k_is_limited_before_its_shuffle(spark, k):
    scored = spark.createDataFrame([(0, 1, 0.5)], "query_id long, doc_id long, score double")
    assert plan(search.top_k(scored, k)).count("WindowGroupLimit") >= 2
