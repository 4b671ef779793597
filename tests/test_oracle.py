"""Every core query that SQL can state, against DuckDB over whole tables."""

import pytest
from conftest import DATA, same_rows

from loomdex.plans import queries as core


def test_registry_and_sql_agree():
    assert set(core.oracle_sql()) <= set(core.queries())


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query(spark, duck, name):
    same_rows(core.queries()[name](spark, DATA), duck.sql(core.oracle_sql()[name]))


def test_what_has_no_sql_is_tested_by_itself():
    """Queries without SQL have a brute-force test of their own; p6_pairs and p6_pages, the
    converged ones, highlight_spans, zh_tokens and zh_categories."""
    bare = set(core.queries()) - set(core.oracle_sql())
    assert bare == {"p6_pages", "p6_pairs", "highlight_spans", "zh_tokens", "zh_categories"} | {n for n in bare if n.endswith("_converged")}


def test_chinese_tokens_of_all_documents_and_categories(spark):
    """An independent cutter over the whole tables."""
    import hashlib
    import re

    words = {w.strip(" ") for (w,) in spark.read.parquet(f"{DATA}/category_postings.parquet").select("term").where("term is not null").collect()}
    known = {w for w in words if re.search("[一-龥]", w) and 1 < len(w) <= 15}

    def cut(text, lower=True):
        bare, out = re.sub("[^a-zA-Z0-9一-龥]", "", text), []
        while bare:
            run = re.match("[a-zA-Z0-9]+", bare)
            word = run[0] if run else next((bare[:k] for k in range(15, 1, -1) if bare[:k] in known), bare[0])
            bare = bare[len(word) :]
            if word not in set("的 了 和 是 在 与 及 而 也 就 都 不 有 这 那 于 以 为 之 其 或 但".split()) and len(word) <= 15:
                out.append(word.lower() if lower else word)
        return out

    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null").collect()
    want = {r.doc_id: (len(t), hashlib.md5(" ".join(t).encode()).hexdigest()) for r in docs for t in [cut("".join(x for x in r.text.split("\n")))]}
    assert {r.doc_id: (r.tokens, r.digest) for r in core.queries()["zh_tokens"](spark, DATA).collect()} == want
    from loomdex.plans.search_queries import pages_now

    own = {r.id: cut("".join(c.strip(" ") for c in r.categories or [] if c and re.search("[一-龥]", c)), False) for r in pages_now(spark, DATA).collect()}
    assert {r.id: r.tokens for r in core.queries()["zh_categories"](spark, DATA).collect()} == {i: " ".join(t) for i, t in own.items() if t}


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
