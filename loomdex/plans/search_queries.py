"""Queries of the search engine's own operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..engine import SearchEngine
from ..functions import text as tx
from ..functions import wikitext
from ..functions.read import current_pages, target, usable
from ..operators import index, links, lookup, recommend, running, search, suggest
from ..session import cut, scratch_path, spread, table
from ..sources import dumps

#: Queries of the examples: words of the corpus, stop words, repeats, unknown words.
QUERIES = ["the stone bridge of the valley", "weekly market weekly", "paper makers council", "first mentioned in zzzz"]
PREFIXES = {"complete_prefix": "list of", "complete_fuzzy": "lisd ov mo", "complete_gate": "zqxw"}
#: Converged reference ranks are small, as mass shrinks with each step.
CONVERGED_DECIMALS = 16


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text"), "doc_id")


def _tokens():
    return tx.tokens_en(tx.lines(F.col("text")))


def pages_now(spark: SparkSession, d: str) -> DataFrame:
    return cut(current_pages(table(spark, d, "pages")), "pages-now")


def tokenize_en(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and distinct tokens of each document."""
    t = corpus(spark, d).select("doc_id", _tokens().alias("t"))
    return t.select("doc_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("distinct_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


def abstract_slice(spark: SparkSession, d: str) -> DataFrame:
    """Abstract lines of each document whose page is known (texts joined with page fields)."""
    ends = pages_now(spark, d).select(F.col("id").alias("page_id"), "abstract_end")
    docs = table(spark, d, "documents").where("text is not null and page_id is not null").select("doc_id", "page_id", "text")
    return docs.join(ends, "page_id").select("doc_id", F.array_join(tx.abstract_slice(F.col("text"), F.col("abstract_end")), "\n").alias("abstract"))


def postings_build(spark: SparkSession, d: str) -> DataFrame:
    built = index.postings(corpus(spark, d), _tokens())
    return built.select("term", "doc_id", F.array_join(F.col("lc").cast("array<string>"), ",").alias("positions"), F.size("lc").alias("n"))


def doc_freq_idf(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d)
    return index.terms(index.postings(docs, _tokens()), docs.count())


def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    return index.build(corpus(spark, d), _tokens())[0].select("term", "doc_id", "tf", "tf_idf")


def doc_norms(spark: SparkSession, d: str) -> DataFrame:
    return index.build(corpus(spark, d), _tokens())[2].select("doc_id", F.round("norm", 4).alias("norm"))


def vocab_stats(spark: SparkSession, d: str) -> DataFrame:
    return index.vocabulary_stats(cut(index.postings(corpus(spark, d), _tokens()), "postings"))


def stopword_case(spark: SparkSession, d: str) -> DataFrame:
    """Stop words that stay in the index because they were capitalised, with their documents."""
    kept = index.postings(corpus(spark, d), _tokens()).where(F.col("term").isin(tx.STOP_WORDS))
    return kept.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(spark: SparkSession, d: str) -> DataFrame:
    _, vocabulary, _ = index.build(corpus(spark, d), _tokens())
    analysed = search.analyse(search.query_table(spark, QUERIES), vocabulary)
    kept = analysed.where("kept").groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]), " ").alias("kept_terms"))
    return search.dropped_terms(analysed).join(kept, "query_id", "left").select("query_id", F.coalesce("kept_terms", F.lit("")).alias("kept_terms"), F.array_join("dropped_terms", " ").alias("dropped"))


def _found(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    weighted, vocabulary, norms = index.build(corpus(spark, d), _tokens())
    vectors = search.query_vectors(search.analyse(search.query_table(spark, QUERIES), vocabulary))
    return search.candidates(vectors, weighted), norms


def or_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d)[0].select("query_id", "doc_id")


def phrase_score(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d)[0].where("phrase > 0").select("query_id", "doc_id", F.col("phrase").cast("double").alias("phrase"))


def vsm_topk(spark: SparkSession, d: str) -> DataFrame:
    top = search.top_k(search.score(*_found(spark, d)), 10, by="vsm", decimals=6)
    return top.select("query_id", "doc_id", F.round("vsm", 6).alias("vsm"), "place")


def _ranks(spark: SparkSession, d: str, now: DataFrame, iterations: int | None, mode: str = "reference") -> tuple[DataFrame, DataFrame]:
    resolved = cut(links.resolve_redirects(now), "resolved")
    edges = cut(links.link_edges(now, resolved), "edges")
    nodes = now.where(target(F.col("redirect")).isNull()).select(F.col("id").alias("doc_id"))
    return links.page_rank(nodes, edges, iterations, mode), resolved


def combined_search(spark: SparkSession, d: str) -> DataFrame:
    """VSM, phrase and page rank of the document's page together, best 6 of each query."""
    return _combined(spark, d, 3, 6)


def combined_search_converged(spark: SparkSession, d: str) -> DataFrame:
    """As :func:`combined_search`, with the ranks of an iteration that goes on to convergence."""
    return _combined(spark, d, None, 9)


def _combined(spark: SparkSession, d: str, iterations: int | None, decimals: int) -> DataFrame:
    ranks, _ = _ranks(spark, d, pages_now(spark, d), iterations)
    of_docs = table(spark, d, "documents").where("page_id is not null").select("doc_id", "page_id").join(ranks.withColumnRenamed("doc_id", "page_id"), "page_id").select("doc_id", "rank")
    found, norms = _found(spark, d)
    top = search.top_k(search.score(found, norms, of_docs), 6, decimals=decimals)
    return top.select("query_id", "doc_id", F.round("score", decimals).alias("score"), "place")


def exact_title(spark: SparkSession, d: str) -> DataFrame:
    """Every title asked in upper case: the first page with that title but for case."""
    now = pages_now(spark, d)
    asked = now.where("title is not null").select(F.col("id").alias("query_id"), F.upper("title").alias("query")).where(F.lower("query") == F.lower("title"))
    return search.exact_titles(asked, now).select("query_id", "id")


def title_promotion(spark: SparkSession, d: str) -> DataFrame:
    """Results of the stored queries by tf_idf with a title hit put first: each query asks, in
    capitals, for the title of the greatest page id among its hits."""
    hits, now = usable_hits(spark, d), pages_now(spark, d)
    top = search.top_k(hits.withColumn("score", F.col("tf_idf")), 6, decimals=6)
    titled = now.where("title is not null").select(F.col("id").alias("doc_id"), "title")
    asked = hits.join(titled, "doc_id").groupBy("query_id").agg(F.upper(F.max_by("title", "doc_id")).alias("query"))
    return search.promote_titles(top, search.exact_titles(asked, now), 6).select("query_id", "doc_id", "place")


def usable_hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_hits").where("query_id is not null and doc_id is not null").groupBy("query_id", "doc_id").agg(F.coalesce(F.max("tf_idf"), F.lit(0.0)).alias("tf_idf"))


def _wildcard(query: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return search.wildcard_titles(pages_now(spark, d), query, 20).select("id", "title", "distance", "place")

    return run


def _complete(query: str, iterations: int | None = 2, decimals: int = 12):
    def run(spark: SparkSession, d: str) -> DataFrame:
        now = pages_now(spark, d)
        ranks, resolved = _ranks(spark, d, now, iterations)
        titles = cut(suggest.title_ranks(now, resolved, ranks).withColumn("rank", F.round("rank", decimals)), "titles")
        return suggest.complete(titles, query).select("id", "title", "place")

    return run


def suggestion_ranks(spark: SparkSession, d: str) -> DataFrame:
    now = pages_now(spark, d)
    ranks, resolved = _ranks(spark, d, now, 2)
    return suggest.title_ranks(now, resolved, ranks).select("id", F.round("rank", 10).alias("rank"))


def suggestion_ranks_converged(spark: SparkSession, d: str) -> DataFrame:
    now = pages_now(spark, d)
    ranks, resolved = _ranks(spark, d, now, None)
    return suggest.title_ranks(now, resolved, ranks).select("id", F.round("rank", CONVERGED_DECIMALS).alias("rank"))


def redirect_resolve(spark: SparkSession, d: str) -> DataFrame:
    return links.resolve_redirects(pages_now(spark, d))


def link_edges(spark: SparkSession, d: str) -> DataFrame:
    now = pages_now(spark, d)
    return links.link_edges(now, cut(links.resolve_redirects(now), "resolved"))


def out_degree(spark: SparkSession, d: str) -> DataFrame:
    return links.out_degrees(link_edges(spark, d))


def _pagerank(mode: str, iterations: int | None = 5, decimals: int = 10):
    """Page rank of the whole graph; without ``iterations`` until it has converged."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        ranks, _ = _ranks(spark, d, pages_now(spark, d), iterations, mode)
        return ranks.select("doc_id", F.round("rank", decimals).alias("rank"))

    return run


def _category_index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    now = current_pages(table(spark, d, "pages").select("id", "title", "redirect", "categories", "edited_at", "loaded_at"))
    tokens = now.select(F.col("id").alias("doc_id"), tx.tokens_category(F.col("categories")).alias("t"))
    kept = cut(tokens.where(F.size("t") > 0), "category-tokens")
    return index.build(kept, F.col("t"), documents=kept.count())


def category_index(spark: SparkSession, d: str) -> DataFrame:
    return _category_index(spark, d)[0].select("term", "doc_id", F.size("lc").alias("n"), "tf_idf")


def recommend_related(spark: SparkSession, d: str) -> DataFrame:
    """Five related pages of every current page whose id is divisible by 20, against all pages."""
    weighted, _, norms = _category_index(spark, d)
    wanted = norms.where("doc_id % 20 = 0").select("doc_id")
    return recommend.related(wanted, weighted, norms).select("doc_id", "related_id", F.round("cosine", 6).alias("cosine"), "place")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("page_id is not null and text is not null")
    return docs.groupBy(F.col("page_id").alias("id")).agg(F.min_by(F.struct("url", "title", "text"), "doc_id").alias("t")).select("id", "t.*")


def find_doc(spark: SparkSession, d: str) -> DataFrame:
    now = pages_now(spark, d)
    found = lookup.find_documents(now.select(F.col("id").alias("doc_id")), now, cut(links.resolve_redirects(now), "resolved"), _texts(spark, d))
    return found.select("doc_id", "id", "title", "url", F.length("text").alias("chars"), "redirect_from", "page_exist")


def find_article(spark: SparkSession, d: str) -> DataFrame:
    """Articles of all title ids: the text record, else the page's fields."""
    ids = table(spark, d, "titles").where("id is not null").select("id").distinct()
    return lookup.find_articles(ids, _texts(spark, d), pages_now(spark, d)).select("id", "title", "has_text")


def title_lookup(spark: SparkSession, d: str) -> DataFrame:
    mapped = dumps.title_map(table(spark, d, "pages"))
    wanted = table(spark, d, "titles").where("title is not null").select("title").distinct()
    return lookup.title_ids(wanted, mapped)


def links_of(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "edges")
    found = lookup.links_of(edges.select(F.col("src").alias("id")).distinct(), edges)
    return found.select("id", F.array_join(F.col("links").cast("array<string>"), ",").alias("links"))


def index_repair(spark: SparkSession, d: str) -> DataFrame:
    """Stored terms with duplicates dropped (the row of least df, then idf, stays) and ids anew."""
    stored = table(spark, d, "terms").where("term is not null")
    order = F.struct(F.coalesce("df", F.lit(2**62)).alias("a"), F.coalesce("idf", F.lit(1e300)).alias("b"))
    return index.repair(stored, "term", order).select("term", "df", "idf", F.col("wi").cast("long").alias("wi"))


def highlight_spans(spark: SparkSession, d: str) -> DataFrame:
    spans = lookup.highlight(F.col("text"), ["stone bridge", "market"])
    found = corpus(spark, d).select("doc_id", spans.alias("s")).where(F.size("s") > 0)
    return found.select("doc_id", F.size("s").alias("spans"), F.array_join(F.transform("s", lambda x: F.concat_ws("-", x["start"], x["end"])), ",").alias("ranges"))


def wikitext_fields(spark: SparkSession, d: str) -> DataFrame:
    """Links, categories and abstract end of every document read as wikitext."""
    parsed = wikitext.parse(corpus(spark, d), "text")
    return parsed.select("doc_id", F.array_join("links", "\n").alias("links"), "abstract_end", F.array_join("categories", "\n").alias("categories"))


def plain_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Running text of every document read as paragraphs of wikitext."""
    shown = corpus(spark, d).select("doc_id", wikitext.plain_text(F.col("text")).alias("x"))
    return shown.select("doc_id", F.length("x").alias("chars"), F.md5(F.col("x").cast("binary")).alias("digest"))


def xml_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Current pages written as a page dump and read again to field records: revisions have ids of
    their own, texts hold each page's links and categories, pages of every third id have no text,
    and a malformed page lies between them; the last two are left out."""
    path = scratch_path(spark, "dump")
    some = F.filter(F.transform(F.coalesce("links", F.array().cast("array<string>")), target), lambda x: x.isNotNull() & ~x.rlike(r"[\[\]{}<>\n]"))
    text = F.concat(F.lit("Page sees "), F.array_join(F.transform(some, lambda x: F.concat(F.lit("[["), x, F.lit("|here]]"))), " and "), F.lit("\n\n== Part ==\n[[Outside]]\n[[Category:Pages|key]]\n[[Category:Id "), F.col("id").cast("string"), F.lit("]]"))
    pages = pages_now(spark, d).where("title is not null").select("id", (F.col("id") + 1_000_000).alias("revision_id"), "title", F.coalesce("redirect", F.lit("")).alias("redirect"), F.when(F.col("id") % 3 != 0, text).alias("text"))
    dumps.write_xml_dump(pages, path)
    broken = "<mediawiki>\n<page>\n<id>seven</id>\n<title>Broken</title>\n<revision><id>1</id><text>x</text></revision>\n</page>\n</mediawiki>"
    spark.createDataFrame([(broken,)], "value string").coalesce(1).write.mode("append").text(path)
    read = dumps.page_fields(dumps.read_xml_dump(spark, path))
    return read.select("id", "title", target(F.col("redirect")).alias("redirect"), F.array_join("links", "\n").alias("links"), "abstract_end", F.array_join("categories", ",").alias("categories"))


def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as text lines and read again with their schema."""
    path = scratch_path(spark, "lines")
    table(spark, d, "documents").select(F.col("doc_id").alias("id"), "url", "title", "text").write.json(path)
    return dumps.read_texts(spark, path).select("id", "url", "title", F.length("text").alias("chars"))


def posting_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Postings of some terms from a catalog sorted by term; the filter reaches the scan."""
    catalog = dumps.Catalog(spark, scratch_path(spark, "catalog"))
    catalog.write("pure_postings", usable(table(spark, d, "postings")))
    return catalog.fetch("pure_postings", ["the", "located", "village", "nothing"]).select("term", "doc_id", "n")


def namespace_filter(spark: SparkSession, d: str) -> DataFrame:
    now = pages_now(spark, d)
    return now.where(wikitext.in_article_space(F.col("title")) & wikitext.no_self_redirect(F.col("title"), target(F.col("redirect")))).select("id", dumps.title_shard(F.col("title")).alias("shard"), dumps.title_shard(F.col("title"), "zh").alias("shard_zh"))


def zh_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Chinese tokens of every document, cut by the category words of the stored index."""
    words = table(spark, d, "category_postings").select(F.trim("term").alias("w")).where(tx.has_han(F.col("w")))
    t = tx.with_tokens_zh(corpus(spark, d), "doc_id", tx.lines(F.col("text")), words)
    return t.select("doc_id", F.size("t").alias("tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


def simplify(spark: SparkSession, d: str) -> DataFrame:
    """Texts with traditional characters of a small map made simplified."""
    made = corpus(spark, d).select("doc_id", "text", tx.to_simplified(F.col("text"), T2S).alias("simple"))
    return made.select("doc_id", F.length("simple").alias("chars"), F.md5(F.col("simple").cast("binary")).alias("digest"))


def simplify_full(spark: SparkSession, d: str) -> DataFrame:
    """Texts with all traditional characters of the full map made simplified."""
    made = corpus(spark, d).select("doc_id", tx.to_simplified(F.col("text")).alias("simple"))
    return made.select("doc_id", F.length("simple").alias("chars"), F.md5(F.col("simple").cast("binary")).alias("digest"))


# Some traditional characters and their simplified forms.
T2S = dict(zip("區當鐵聞屬紡織學開從來關於種說這過並條約稅發現時間書讀語話長門風馬魚鳥龍", "区当铁闻属纺织学开从来关于种说这过并条约税发现时间书读语话长门风马鱼鸟龙"))


def snippets(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select("doc_id", F.md5(tx.snippet(tx.strip_title_header(F.col("text"))).cast("binary")).alias("digest"))


def result_page(spark: SparkSession, d: str) -> DataFrame:
    """Second page of ten of the hits of query 1 by tf_idf."""
    return _paged(usable_hits(spark, d).where("query_id = 1")).where("page = 2").select("doc_id", "place", "pages")


def result_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page of ten of the hits of every query by tf_idf."""
    return _paged(usable_hits(spark, d))


def _paged(hits: DataFrame, size: int = 10) -> DataFrame:
    """All hits with their page and place; a hot query's places are summed in ranges."""
    hits = cut(hits.select("query_id", "doc_id", (-F.round("tf_idf", 6)).alias("down"), F.lit(1).alias("one")), "hits")
    totals = hits.groupBy("query_id").agg((F.floor(F.count(F.lit(1)) / size) + 1).cast("long").alias("pages"))
    placed = running.running_sum(hits, ["query_id"], ["down", "doc_id"], {"place": "one"}).join(totals, "query_id")
    return placed.select("query_id", F.ceil(F.col("place") / size).cast("int").alias("page"), "doc_id", F.col("place").cast("int").alias("place"), "pages")


# ---------------------------------------------------------------- the engine, end to end

_built: dict[tuple[str, str], SearchEngine] = {}


def engine(spark: SparkSession, d: str) -> SearchEngine:
    """A catalog of the pages and the texts of all documents, built once per folder and session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _built:
        made = SearchEngine(spark, scratch_path(spark, "engine"), scope="full")
        made.build(pages_now(spark, d).drop("edited_at", "loaded_at"), _texts(spark, d), rank_iterations=2)
        _built[key] = made
    return _built[key]


def _a_title(e: SearchEngine) -> str:
    return e.catalog.read("pages").where(F.col("title").rlike("^[A-Za-z ]+$")).agg(F.min("title")).first()[0] or ""


def engine_search(spark: SparkSession, d: str) -> DataFrame:
    """Whole searches of the example queries and of one title in capitals: title first, ranked
    documents, dropped terms, redirects followed, texts fetched."""
    e = engine(spark, d)
    out = None
    for i, q in enumerate([*QUERIES, _a_title(e).upper()]):
        one = e.search(q).select(F.lit(i).cast("long").alias("query_id"), "place", "doc_id", "id", "title", "url", F.length("text").alias("chars"), "redirect_from", "page_exist", F.array_join("dropped_terms", " ").alias("dropped"))
        out = one if out is None else out.unionByName(one)
    return out


def engine_search_many(spark: SparkSession, d: str) -> DataFrame:
    """The same searches as one batch: documents and places only."""
    e = engine(spark, d)
    asked = search.query_table(spark, [*QUERIES, _a_title(e).upper()])
    return e.search_many(asked).select("query_id", "doc_id", "place")


def engine_wildcard(spark: SparkSession, d: str) -> DataFrame:
    """A query with ``*`` given to the search as it is goes to the titles."""
    return engine(spark, d).search("m*riki", 20).select("doc_id", "place", "page_exist")


def engine_complete(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).complete_query(PREFIXES["complete_prefix"]).select("id", "title", "place")


def engine_recommend(spark: SparkSession, d: str) -> DataFrame:
    """Related pages of the smallest page id divisible by 20 that has categories."""
    e = engine(spark, d)
    first = e.catalog.read("category_norms").where("doc_id % 20 = 0").agg(F.min("doc_id")).first()[0]
    if first is None:
        return spark.createDataFrame([], "doc_id long, related_id long, cosine double, place int")
    return e.recommend_sim_doc(first).select(F.lit(first).alias("doc_id"), "related_id", F.round("cosine", 6).alias("cosine"), "place")


def catalog_zones(spark: SparkSession, d: str) -> DataFrame:
    """Zone map of the stored pages: files cover the ids without overlap, and all of them."""
    zones = engine(spark, d).catalog.zone_map("pages")
    before = Window.orderBy("first")  # one row per file
    apart = zones.select("first", "last", (F.coalesce(F.lag("last").over(before), F.lit(-2**62)) < F.col("first")).alias("apart"))
    return apart.agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("apart").alias("apart")).where("first is not null")


def catalog_categories(spark: SparkSession, d: str) -> DataFrame:
    """The stored category index."""
    return engine(spark, d).catalog.read("category_postings").select("term", "doc_id", F.size("lc").alias("n"), "tf_idf")


def load_or_compute(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the stored index, written on first use and read from there on the second."""
    catalog = dumps.Catalog(spark, scratch_path(spark, "catalog"))
    made = []
    compute = lambda: made.append(1) or index.terms(usable(table(spark, d, "postings")), table(spark, d, "postings").select("doc_id").distinct().where("doc_id is not null").count())
    catalog.load_or_compute("terms", compute)
    return catalog.load_or_compute("terms", compute).select("term", "df", F.lit(len(made)).alias("computed"))


def chunked_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents written in files of at most 100 rows and read again: no file has more."""
    path = scratch_path(spark, "chunks")
    dumps.write_chunks(table(spark, d, "documents").select("doc_id"), path, 100)
    per_file = spark.read.schema("doc_id long").parquet(path).groupBy(F.col("_metadata.file_name")).agg(F.count(F.lit(1)).alias("n"))
    return per_file.agg(F.sum("n").alias("rows"), (F.max("n") <= 100).alias("bounded")).where("rows is not null")


def globbed_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents as lines of ``wiki`` files of several folders beside others that are not read."""
    path = scratch_path(spark, "corpus")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "url", "title", "text")
    docs.withColumn("folder", F.col("id") % 3).write.partitionBy("folder").json(f"{path}/AA")
    return dumps.read_texts(spark, path, "part*.json").select("id", F.length("text").alias("chars"))


def stop_words_file(spark: SparkSession, d: str) -> DataFrame:
    """Postings of terms by a stop list read from a file: those of the built-in list are gone."""
    path = scratch_path(spark, "stop")
    spark.createDataFrame([(f" {w}\r",) for w in [*tx.STOP_WORDS, ""]], "value string").coalesce(1).write.text(path)
    stop = tx.read_stop_words(spark, path)
    kept = table(spark, d, "postings").select(F.trim(F.lower("term")).alias("term")).where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return kept.where(~F.col("term").isin(stop))


def title_shards(spark: SparkSession, d: str) -> DataFrame:
    """Titles of all pages in folders by first letter, read again from the folder of ``L``."""
    path = scratch_path(spark, "shards")
    dumps.write_title_shards(dumps.title_map(table(spark, d, "pages")), path)
    return spark.read.schema("title string, id long, shard string").parquet(path).where("shard = 'L'").select("title", "id")


def articles_by_title(spark: SparkSession, d: str) -> DataFrame:
    mapped = dumps.title_map(table(spark, d, "pages"))
    found = lookup.find_articles_by_title(table(spark, d, "titles").select("title"), mapped, _texts(spark, d), pages_now(spark, d))
    return found.select("asked", "id", "title", "has_text")


def links_by_title(spark: SparkSession, d: str) -> DataFrame:
    found = lookup.links_of_titles(table(spark, d, "titles").select("title"), dumps.title_map(table(spark, d, "pages")), table(spark, d, "edges"))
    return found.select("title", "id", F.array_join(F.col("links").cast("array<string>"), ",").alias("links"))


def zh_categories(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the Chinese categories of current pages, cut by the stored index's category words,
    case kept."""
    words = table(spark, d, "category_postings").select(F.trim("term").alias("w")).where(tx.has_han(F.col("w")))
    own = F.transform(F.filter(F.coalesce("categories", F.array().cast("array<string>")), tx.has_han), F.trim)
    cut_ = tx.with_tokens_zh(pages_now(spark, d).where("id is not null"), "id", own, words, lower=False)
    return cut_.where(F.size("t") > 0).select("id", F.array_join("t", " ").alias("tokens"))


def completion_with_history(spark: SparkSession, d: str) -> DataFrame:
    """Completions of ``list of`` with earlier queries that begin so, as a page lists them."""
    hints = engine(spark, d).complete_query(PREFIXES["complete_prefix"])
    history = spark.createDataFrame([("List of old queries",), ("list of 3",), ("weekly market",), ("",)], "query string")
    return suggest.shown_hints(suggest.with_history(hints, history, PREFIXES["complete_prefix"])).select("title")


REGISTRY = {f.__name__: f for f in (
    tokenize_en, abstract_slice, postings_build, doc_freq_idf, tfidf_weights, doc_norms, vocab_stats, stopword_case, query_terms, or_candidates, phrase_score, vsm_topk, combined_search,
    exact_title, title_promotion, suggestion_ranks, combined_search_converged, suggestion_ranks_converged, redirect_resolve, link_edges, out_degree, category_index, recommend_related, find_doc, find_article, title_lookup, links_of, index_repair,
    highlight_spans, wikitext_fields, plain_paragraphs, xml_round_trip, json_round_trip, posting_fetch, namespace_filter, zh_tokens, simplify, simplify_full, snippets, result_page, result_pages,
    engine_search, engine_search_many, engine_wildcard, engine_complete, engine_recommend, catalog_zones, catalog_categories, load_or_compute, chunked_files, globbed_texts, stop_words_file,
    title_shards, articles_by_title, links_by_title, zh_categories, completion_with_history)}
REGISTRY |= {"wildcard_star": _wildcard("m*riki"), "wildcard_qmark": _wildcard("?alley"), "pagerank_ref_5": _pagerank("reference"), "pagerank_std_5": _pagerank("standard")}
REGISTRY |= {name: _complete(q) for name, q in PREFIXES.items()}
REGISTRY |= {f"pagerank_{short}_converged": _pagerank(mode, None, CONVERGED_DECIMALS) for short, mode in (("ref", "reference"), ("std", "standard"))}
REGISTRY |= {f"{name}_converged": _complete(q, None, CONVERGED_DECIMALS) for name, q in PREFIXES.items()}
