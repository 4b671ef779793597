"""The micro-corpus with numbers worked out by hand from the formulas."""

import math
import re

import pytest
from pyspark.sql import functions as F

from loomdex.engine import SearchEngine
from loomdex.functions import text as tx
from loomdex.operators import index, links, lookup, recommend, search, suggest
from loomdex.plans import search_queries

STOP = ["the", "and", "near", "again"]
PAGES = [
    (1, "Alpha Ring", "", ["Blue Bolt", "Green Gear"], 2, ["red rings"]), (2, "Blue Bolt", "", ["Alpha Ring"], 1, ["blue bolts"]),
    (3, "Green Gear", "", ["Alfa Ring"], 1, ["green gears of blue"]), (4, "Red Widget", "", [], 0, ["red gears"]),
    (5, "Alfa Ring", "Alpha Ring", [], 0, []), (6, "Alpha-R", "Alfa Ring", [], 0, []), (7, "Lost Page", "Nowhere", [], 0, []),
]
TEXTS = [
    (1, "u1", "Alpha Ring", "Alpha Ring\n\nred ring near blue bolt\nred ring again"), (2, "u2", "Blue Bolt", "Blue Bolt\n\nblue bolt holds red ring"),
    (3, "u3", "Green Gear", "Green Gear\n\nThe green gear turns blue bolt"), (4, "u4", "Red Widget", "Red Widget\n\nred widget and red gear"),
]
PAGE = "id long, title string, redirect string, links array<string>, abstract_end int, categories array<string>"
TEXT = "id long, url string, title string, text string"


@pytest.fixture(scope="module")
def built(spark):
    pages, texts = spark.createDataFrame(PAGES, PAGE), spark.createDataFrame(TEXTS, TEXT)
    docs = texts.join(pages.select("id", "abstract_end"), "id")
    tokens = tx.tokens_en(tx.abstract_slice(F.col("text"), F.col("abstract_end")), STOP)
    weighted, vocabulary, norms = index.build(docs, tokens, "id")
    return pages, texts, weighted, vocabulary, norms


def test_weights(built):
    _, _, weighted, vocabulary, norms = built
    got = {(r.term, r.doc_id): (r.lc, r.tf_idf) for r in weighted.collect()}
    assert got["ring", 1] == ([1, 5], 0.3916) and got["red", 4] == ([0, 2], 0.1625) and got["the", 3] == ([0], 0.6021) and got["blue", 3] == ([4], 0.1249)
    assert {r.term: (r.df, r.idf) for r in vocabulary.collect()}["gear"] == (2, 0.301)
    assert {r.doc_id: round(r.norm, 6) for r in norms.collect()} == pytest.approx({1: 0.4593, 2: 0.707054, 3: 1.099716, 4: 0.692482}, abs=1e-4)


def test_norm_is_length_of_weights(built):
    _, _, weighted, _, norms = built
    sums: dict[int, float] = {}
    for r in weighted.collect():
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.tf_idf**2
    assert {r.doc_id: round(r.norm**2, 9) for r in norms.collect()} == {k: round(v, 9) for k, v in sums.items()}


@pytest.mark.parametrize(("query", "kept", "dropped", "ranked"), [
    ("red ring", ["red", "ring"], [], [(1, 0.127542, 1.0), (2, 0.048949, 0.5), (4, 0.001825, 0.0)]),
    ("the blue gear", ["blue", "gear"], ["the"], [(4, 0.036374, 0.0), (3, 0.031471, 0.0), (1, 0.001626, 0.0), (2, 0.001056, 0.0)]),
    ("Green xyz", ["green"], ["xyz"], [(3, 0.198484, 0.0)]),
])
def test_scores(spark, built, query, kept, dropped, ranked):
    _, _, weighted, vocabulary, norms = built
    analysed = search.analyse(search.query_table(spark, [query]), vocabulary, STOP)
    assert [r.term for r in analysed.where("kept").orderBy("place").collect()] == kept
    assert search.dropped_terms(analysed).first().dropped_terms == dropped
    top = search.top_k(search.score(search.candidates(search.query_vectors(analysed), weighted), norms), 10).orderBy("place").collect()
    assert [(r.doc_id, pytest.approx(r.vsm, abs=2e-6), float(r.phrase)) for r in top] == [(d, pytest.approx(v, abs=2e-6), p) for d, v, p in ranked]


def test_search_does_not_depend_on_partitions(spark, built):
    _, _, weighted, vocabulary, norms = built
    vectors = search.query_vectors(search.analyse(search.query_table(spark, ["red ring gear red"]), vocabulary, STOP))
    run = lambda w: [(r.doc_id, round(r.score, 9)) for r in search.top_k(search.score(search.candidates(vectors, w), norms), 10).orderBy("place").collect()]
    whole = run(weighted.coalesce(1))
    assert whole == run(weighted.repartition(7)) and len(whole) == 4
    shorter = search.top_k(search.score(search.candidates(vectors, weighted), norms), 2).orderBy("place").collect()
    assert [r.doc_id for r in shorter] == [d for d, _ in whole[:2]]


def test_redirects_and_rank(spark, built):
    pages = built[0]
    resolved = links.resolve_redirects(pages)
    assert {r.id: r.resolved_id for r in resolved.collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 1, 7: None}
    edges = links.link_edges(pages, resolved)
    assert sorted(map(tuple, edges.collect())) == [(1, 2), (1, 3), (2, 1), (3, 1)]
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "doc_id long")
    ranks = lambda **kw: {r.doc_id: r.rank for r in links.page_rank(nodes, edges, **kw).collect()}
    assert ranks(iterations=3) == pytest.approx({1: 0.40081641, 2: 0.14716113, 3: 0.14716113, 4: 0.00390625}, abs=1e-8)
    standard = ranks(iterations=3, mode="standard")
    assert standard == pytest.approx({1: 0.51858838, 2: 0.21592529, 3: 0.21592529, 4: 0.04956104}, abs=1e-8) and sum(standard.values()) == pytest.approx(1)
    assert sum(ranks(iterations=2).values()) == pytest.approx((0.85 + 0.15 / 4) ** 2)


def test_rank_stops_before_the_last_step(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "doc_id long")
    edges = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    # balanced from the start: the standard step changes nothing and the start is returned
    assert [r.rank for r in links.page_rank(nodes, edges, mode="standard").collect()] == [0.5, 0.5]
    assert links.page_rank(nodes.limit(0), edges).count() == 0


def test_redirect_cycle_is_unresolved(spark):
    rows = [(1, "A", "B", [], 0, []), (2, "B", "A", [], 0, []), (3, "C", "C", [], 0, []), (4, "D", "A", [], 0, [])]
    assert {r.resolved_id for r in links.resolve_redirects(spark.createDataFrame(rows, PAGE)).collect()} == {None}


def test_recommend(spark, built):
    pages = built[0]
    stop = [*STOP, "of"]
    tokens = pages.select("id", tx.tokens_category(F.col("categories"), stop).alias("t")).where(F.size("t") > 0)
    weighted, _, norms = index.build(tokens, F.col("t"), "id", tokens.count())
    found = recommend.related(pages.select(F.col("id").alias("doc_id")), weighted, norms, 5, stop).orderBy("doc_id", "place").collect()
    assert [(r.doc_id, r.related_id, pytest.approx(r.cosine, abs=1e-5)) for r in found] == [
        (1, 4, pytest.approx(0.316186, abs=1e-5)), (2, 3, pytest.approx(0.18253, abs=1e-5)), (3, 4, pytest.approx(0.288643, abs=1e-5)), (3, 2, pytest.approx(0.18253, abs=1e-5)),
        (4, 1, pytest.approx(0.316186, abs=1e-5)), (4, 3, pytest.approx(0.288643, abs=1e-5))]


def nearest_by_brute_force(docs, wanted, k, stop=()):
    """Of ``{doc: {term: weight}}``: ``{(doc, related, place): cosine}`` by comparing all pairs."""
    out = {}
    for a in wanted:
        own = {t: v for t, v in docs[a].items() if t not in stop}
        found = []
        for b, other in docs.items():
            if b != a and own.keys() & other.keys():
                length = sum(v * v for v in own.values()) ** 0.5 * sum(v * v for v in other.values()) ** 0.5
                cosine = sum(own[t] * other[t] for t in own.keys() & other.keys()) / length if length else 0.0
                found.append((-round(cosine, 9), b, cosine))
        out |= {(a, b, i + 1): cosine for i, (_, b, cosine) in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize("block", [recommend.BLOCK, 2_000])
def test_recommend_takes_many_classes_in_one_pass(spark, block, monkeypatch):
    import random

    monkeypatch.setattr(recommend._nearest_classes, "__defaults__", (block,))
    r = random.Random(5)
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(400)]
    docs = {i: {t: round(r.uniform(0.2, 0.5), 4) for t in r.sample(common, 2)} | {t: round(r.uniform(1, 3), 4) for t in r.sample(rare, r.randint(0, 3))} for i in range(5_000)}
    docs |= {i + 5_000: docs[i] for i in range(20)} | {9_000 + i: {"zero": 0.0, "only": 1.5} for i in range(8)} | {9_100: {"zero": 0.0}, 9_101: {"of": 1.0}, 9_102: {"alone": 2.0}}
    weighted = spark.createDataFrame([(d, t, v) for d, ts in docs.items() for t, v in ts.items()], "doc_id long, term string, tf_idf double").repartition(4)
    found = recommend.related(spark.createDataFrame([(i,) for i in docs], "doc_id long"), weighted, index.norms(weighted), 5, ["of"])
    if block == recommend.BLOCK:  # the classes are few: each wanted class meets them once
        assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    rows = {(x.doc_id, x.related_id, x.place): x.cosine for x in found.collect()}
    some = [*range(0, 5_000, 50), *range(5_000, 5_020, 4), *range(9_000, 9_008), 9_100, 9_101, 9_102]
    assert {x: c for x, c in rows.items() if x[0] in some} == pytest.approx(nearest_by_brute_force(docs, some, 5, ["of"]), abs=1e-9)


def test_completion(spark):
    titles = spark.createDataFrame([(i, t, 0.1 * i) for i, t in enumerate(["Alpha Ring", "Blue Bolt", "Green Gear", "Red Widget", "Gear Green", "Lost Page"])], "id long, title string, rank double")
    said = lambda q, n=6: [r.title for r in suggest.complete(titles, q, n).orderBy("place").collect()]
    assert said("green") == ["Green Gear"] and said("blua bo") == ["Blue Bolt"] and said("GREEN") == [] and said("x") == []
    assert suggest.complete(titles.limit(0), "green").count() == 0
    history = spark.createDataFrame([("green tea",), ("red",)], "query string")
    assert {r.title for r in suggest.with_history(suggest.complete(titles, "green"), history, "green").collect()} == {"Green Gear", "green tea"}
    assert suggest.with_history(titles, history, " ").count() == 0
    listed = spark.createDataFrame([("b",), ("",), ("a",), ("a2",)], "title string")
    assert [r.title for r in suggest.shown_hints(listed).collect()] == ["a", "b"]


def test_whole_title_comes_first(spark):
    titles = spark.createDataFrame([(1, "Ring", 0.0), (2, "Ring one", 0.9), (3, "Ring two", -1.0)], "id long, title string, rank double")
    assert [r.id for r in suggest.complete(titles, "ring").orderBy("place").collect()] == [1, 2, 3]


def test_wildcards(spark):
    pages = spark.createDataFrame(list(enumerate(["Alpha Ring", "Blue Bolt", "Green Gear", "Red Widget", "ring-bolt", "bring"])), "id long, title string")
    said = lambda q: {r.title for r in search.wildcard_titles(pages, q).collect()}
    assert said("r*g") == {"Alpha Ring", "ring-bolt"} and said("b?lt") == {"Blue Bolt", "ring-bolt"} and said("(*") == set()
    assert search.is_wildcard("a*") and search.is_wildcard("a?") and not search.is_wildcard("a.")


def test_promotion(spark):
    top = spark.createDataFrame([(0, 5, 1), (0, 6, 2), (1, 7, 1), (2, 9, 1), (2, 8, 2)], "query_id long, doc_id long, place int")
    hits = spark.createDataFrame([(0, 9), (2, 8), (3, 4)], "query_id long, id long")
    got = {}
    for r in search.promote_titles(top, hits, 2).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == {0: [9, 5], 1: [7], 2: [8, 9], 3: [4]}


def test_zero_idf_divides_safely(spark):
    docs = spark.createDataFrame([(1, "ring"), (2, "ring")], "doc_id long, text string")
    weighted, vocabulary, norms = index.build(docs, tx.tokens_en(tx.lines(F.col("text"))))
    analysed = search.analyse(search.query_table(spark, ["ring"]), vocabulary)
    assert [r.score for r in search.score(search.candidates(search.query_vectors(analysed), weighted), norms).collect()] == [0.0, 0.0]


def test_stop_words_are_tested_before_lower_case(spark):
    row = spark.createDataFrame([("The the don't well-known x1 Ünder",)], "text string")
    assert row.select(tx.tokens_en(tx.lines(F.col("text")), ["the", "dont"])).first()[0] == ["the", "wellknown"]


def test_highlight_and_pages(spark):
    df = spark.createDataFrame([("a.b ab A.B",), (None,), ("",)], "text string")
    spans = [r.s for r in df.select(lookup.highlight(F.col("text"), ["a.b"]).alias("s")).collect()]
    assert [tuple(x) for x in spans[0]] == [(0, 3), (7, 10)] and spans[1] is None and spans[2] == []
    results = spark.createDataFrame([(i, i) for i in range(1, 26)], "doc_id long, place int")
    page = lookup.page_of(results, 3).collect()
    assert [r.doc_id for r in page] == [21, 22, 23, 24, 25] and page[0].pages == 3


def test_repair_and_dense_ids(spark):
    stored = spark.createDataFrame([("b", 9, 1), ("a", 5, 2), ("b", 3, 3)], "term string, wi long, n long")
    assert sorted(map(tuple, index.repair(stored, "term", F.col("n")).select("term", "n", "wi").collect())) == [("a", 2, 0), ("b", 1, 1)]
    many = spark.range(0, 500).select((F.col("id") * 7 % 500).alias("k"))
    assert all(r.k == r.at for r in index.dense_ids(many, "k", "at").collect())


def test_engine(spark, tmp_path):
    engine = SearchEngine(spark, str(tmp_path), "en", STOP)
    engine.build(spark.createDataFrame(PAGES, PAGE), spark.createDataFrame(TEXTS, TEXT), rank_iterations=3)
    found = engine.search("green gear", 2).collect()
    assert [r.id for r in found] == [3, 4] and found[0].bold_range and found[0].text.startswith("The green")
    assert [r.id for r in engine.search("alfa ring", 3).collect()][0] == 1 and engine.search("alfa ring", 3).first().redirect_from == "Alfa Ring"
    assert not engine.search("l?st", 3).first().page_exist
    assert engine.title_search("RED WIDGET").first().id == 4
    # the title of one edit less comes after the two that begin with the query
    assert [r.title for r in engine.complete_query("alpha").collect()] == ["Alpha Ring", "Alpha-R", "Alfa Ring"]
    assert [r.related_id for r in engine.recommend_sim_doc(1).collect()] == [4] and engine.recommend_sim_doc(5).count() == 0
    many = engine.search_many(search.query_table(spark, ["green gear", "the lost page", "zz"]), 2).orderBy("query_id", "place").collect()
    assert [(r.query_id, r.doc_id, r.place) for r in many] == [(0, 3, 1), (0, 4, 2)] and many[0].dropped_terms == []
    with pytest.raises(ValueError):
        engine.recommend_sim_doc(99)
    assert engine.find_doc(6).first().id == 1 and engine.links_of(1).first().links == [2, 3]
    assert engine.catalog.zone_map("pages").agg(F.min("first"), F.max("last")).first() == (1, 7)
    assert engine.catalog.fetch("postings", ["red"]).count() == 3
    with pytest.raises(ValueError):
        SearchEngine(spark, str(tmp_path), "fr")


def test_chinese_engine(spark, tmp_path):
    pages = [(1, "木灯塔", "", [], 1, ["古代桥梁"]), (2, "铸铜厂", "", ["木灯塔"], 1, ["古代工厂"])]
    texts = [(1, "", "木灯塔", "木灯塔\n\n木灯塔属于政府"), (2, "", "铸铜厂", "铸铜厂\n\n铸铜厂在木灯塔的南部")]
    engine = SearchEngine(spark, str(tmp_path), "zh", lexicon=["木灯塔", "铸铜厂", "政府", "南部", "古代", "桥梁", "工厂", "属于"])
    engine.build(spark.createDataFrame(pages, PAGE), spark.createDataFrame(texts, TEXT), rank_iterations=2)
    assert {r.id for r in engine.search("南部木灯塔").collect()} == {1, 2}
    assert [r.related_id for r in engine.recommend_sim_doc(1).collect()] == [2]
    assert math.isclose(engine.catalog.read("terms").where("term = '政府'").first().idf, round(math.log10(2), 4))


def test_segmentation_and_variants(spark):
    assert tx.segment_longest("木灯塔abc属于", frozenset({"木灯塔", "灯塔"}), 3) == ["木灯塔", "abc", "属", "于"]
    df = spark.createDataFrame([("鐵\n路\t",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.to_simplified(F.col("t"), {"鐵": "铁"})).collect()] == ["铁路", None]


def test_last_row_of_an_id_stays(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "id long, text string, file int")
    assert sorted((r.id, r.text) for r in index.last_per_id(df, "id", F.col("file")).collect()) == [(1, "b"), (2, "c")]


def test_calls_are_timed(caplog):
    from loomdex.session import timed

    with caplog.at_level("INFO", "loomdex"):
        assert timed(lambda x: x + 1)(1) == 2
    assert "took" in caplog.text


def test_simplification_by_the_full_map(spark, tmp_path):
    import hashlib

    df = spark.createDataFrame([(1, "圖畫節記數許們個紙錄東橋鐵\n路 Abc")], "doc_id long, text string")
    assert df.select(tx.to_simplified(F.col("text"))).first()[0] == "图画节记数许们个纸录东桥铁路 Abc"
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert search_queries.simplify_full(spark, str(tmp_path)).first().digest == hashlib.md5("图画节记数许们个纸录东桥铁路 Abc".encode()).hexdigest()
    assert len(tx.simplified()) == 3074 and {k: tx.simplified()[k] for k in search_queries.T2S} == search_queries.T2S


@pytest.mark.parametrize(("name", "reference"), [("pagerank_ref_converged", True), ("pagerank_std_converged", False)])
def test_registered_rank_converges(spark, tmp_path, name, reference):
    # a chain of eight pages into a pair that links to each other: depth matters after two steps
    out = {i: [i + 1] for i in range(1, 9)} | {9: [10, 1], 10: [9]}
    rows = [(i, f"t{i}", "", [f"t{j}" for j in to], 0, [], "2021-01-01", "2021-01-01") for i, to in out.items()]
    spark.createDataFrame(rows, f"{PAGE}, edited_at string, loaded_at string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    old, n = dict.fromkeys(out, 1 / len(out)), len(out)
    for step in range(100):
        new = {i: 0.85 * sum(old[j] / len(to) for j, to in out.items() if i in to) + 0.15 / n * (old[i] if reference else 1) for i in out}
        if sum(abs(new[i] - old[i]) for i in out) < 1e-4:
            break
        old = new
    got = {r.doc_id: r.rank for r in search_queries.REGISTRY[name](spark, str(tmp_path)).collect()}
    assert step > 5 and got == pytest.approx(old, abs=1e-12)


def test_results_are_paged_for_every_query_to_the_end(spark, tmp_path):
    rows = [(q, i, float(i % 700)) for q, n in ((1, 1234), (2, 20), (3, 3)) for i in range(n)]
    spark.createDataFrame([*rows, rows[0], (1, None, 9.0), (None, 1, 9.0)], "query_id long, doc_id long, tf_idf double").write.parquet(f"{tmp_path}/query_hits.parquet")
    want = set()
    for q, n in ((1, 1234), (2, 20), (3, 3)):
        ordered = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))
        want |= {(q, i // 10 + 1, r[1], i + 1, n // 10 + 1) for i, r in enumerate(ordered)}
    assert set(map(tuple, search_queries.result_pages(spark, str(tmp_path)).collect())) == want
    assert {r.pages for r in search_queries.result_page(spark, str(tmp_path)).collect()} == {124}


def test_every_category_word_cuts_chinese_texts(spark, tmp_path):
    words = spark.range(50_000).select(F.concat(F.lit("一"), F.expr("char(19968 + cast(id / 20000 as int))"), F.expr("char(19968 + cast(id % 20000 as int))")).alias("term"))
    words.unionByName(spark.createDataFrame([("鿀鿁",), ("龠龡",)], "term string")).write.parquet(f"{tmp_path}/category_postings.parquet")
    spark.createDataFrame([(1, "龠龡")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert search_queries.zh_tokens(spark, str(tmp_path)).first().tokens == 1


def test_last_file_wins_in_the_engine(spark, tmp_path):
    engine = SearchEngine(spark, str(tmp_path), "en", STOP)
    pages = spark.createDataFrame([*[(*p, "f1") for p in PAGES], (4, "Red Widget", "", [], 0, ["blue bolts"], "f2")], f"{PAGE}, file string")
    texts = spark.createDataFrame([(*TEXTS[0], "f1"), (1, "u9", "Alpha Ring", "Alpha Ring\n\nblue wheel", "f2"), *[(*t, "f1") for t in TEXTS[1:]], (*TEXTS[1], "f1")], f"{TEXT}, file string")
    engine.build(pages, texts, rank_iterations=2)
    found = engine.search("wheel", 3).collect()
    assert [(r.id, r.url, r.text) for r in found] == [(1, "u9", "blue wheel")] and engine.search("holds", 5).count() == 1
    places = [r.place for r in engine.search("blue", 5).collect()]
    assert places == sorted(set(places)) and engine.catalog.fetch("pages", [4]).first().categories == ["blue bolts"]
    assert engine.catalog.fetch("postings", ["blue"]).where("doc_id = 1").first().lc == [0]


def test_running_sum_parts_ties_of_the_first_column(spark):
    from loomdex.operators import running

    df = spark.createDataFrame([("hot", 5, i, 1) for i in range(4_000)] + [("b", 1, 1, 1)], "g string, at long, i long, v long")
    got = running.running_sum(df, ["g"], ["at", "i"], {"upto": "v"}, heavy_rows=100, ranges=8)
    assert {r.i: r.upto for r in got.where("g = 'hot'").collect()} == {i: i + 1 for i in range(4_000)}
    shown = got._jdf.queryExecution().executedPlan().toString()
    assert "_range" in shown  # each range is summed apart


def test_lexicons_of_any_size_cut_alike(spark):
    import random

    rng = random.Random(1)
    signs = "古石桥在山路上有村里的人和渡口"
    lexicon = {"".join(rng.choices(signs, k=rng.randrange(1, 5))) for _ in range(60)}
    rows = [(i, "".join(rng.choices(signs + "ab1。", k=rng.randrange(0, 60)))) for i in range(80)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("w", F.lit("clash"))
    words = spark.createDataFrame([(w,) for w in lexicon], "w string")
    cut_by = lambda most: {r.doc_id: r.t for r in tx.with_tokens_zh(docs, "doc_id", F.array("text"), words, most=most).collect()}
    joined = cut_by(0)
    assert joined == cut_by(10**6)
    known, stop = {w for w in lexicon if len(w) > 1}, set(tx.STOP_WORDS_ZH)
    for i, text in rows:  # an independent cutter
        bare, want = re.sub("[^a-zA-Z0-9一-龥]", "", text or ""), []
        while bare:
            run = re.match("[a-zA-Z0-9]+", bare)
            word = run[0] if run else next((bare[:k] for k in range(4, 1, -1) if bare[:k] in known), bare[0])
            want += [] if word in stop else [word]
            bare = bare[len(word) :]
        assert joined[i] == want, text


def test_too_long_stop_lists_are_refused(spark, tmp_path, monkeypatch):
    (tmp_path / "stop").write_text("a\nb\nc\n")
    monkeypatch.setattr(tx, "MOST_STOP_WORDS", 2)
    with pytest.raises(ValueError):
        tx.read_stop_words(spark, str(tmp_path / "stop"))


def test_highlight_spans_of_all_documents(spark):
    from conftest import DATA

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null").collect()}
    want = {}
    for i, t in texts.items():
        spans = [f"{m.start()}-{m.end()}" for p in (r"\bstone\ bridge\b", r"\bmarket\b") for m in re.finditer(p, t, re.I)]
        if spans:
            want[i] = (len(spans), ",".join(spans))
    assert {r.doc_id: (r.spans, r.ranges) for r in search_queries.highlight_spans(spark, DATA).collect()} == want and want


def test_characters_of_two_readings_by_word(spark):
    df = spark.createDataFrame([("著名學者隨著乾隆的專著沿著乾的河",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.to_simplified(F.col("t"))).collect()] == ["著名学者随着乾隆的专著沿着干的河", None]
    assert df.select(tx.to_simplified(F.col("t"), {"著": "着"}, ["著名"])).first()[0] == "著名學者隨着乾隆的專着沿着乾的河"


def test_a_segmenter_cuts_instead_of_the_lexicon(spark, tmp_path):
    pages = [(1, "木灯塔", "", [], 1, ["古代桥梁"]), (2, "铸铜厂", "", [], 1, ["古代工厂"])]
    texts = [(1, "", "木灯塔", "木灯塔\n\n木灯塔属于政府"), (2, "", "铸铜厂", "铸铜厂\n\n铸铜厂的南部")]
    engine = SearchEngine(spark, str(tmp_path), "zh", segmenter=lambda t: [t[i : i + 2] for i in range(0, len(t), 2)])
    engine.build(spark.createDataFrame(pages, PAGE), spark.createDataFrame(texts, TEXT), rank_iterations=1)
    assert {r.term for r in engine.catalog.read("terms").collect()} == {"木灯", "塔属", "于政", "府", "铸铜", "厂的", "南部"}
    assert [r.id for r in engine.search("木灯").collect()] == [1]
