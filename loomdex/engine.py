"""One object over a stored catalog: search, completion, wildcard and title search, recommendation."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .functions.read import target
from .operators import index, links, lookup, recommend, search, suggest
from .session import cut, timed
from .sources.dumps import Catalog


def _together(*tasks: Callable) -> list:
    """Results of some tasks run at the same time, each on a thread that submits its own jobs."""
    with ThreadPoolExecutor(len(tasks)) as pool:
        return [f.result() for f in [pool.submit(t) for t in tasks]]


class SearchEngine:
    """``language`` is ``en`` or ``zh``. Build the catalog once from pages ``(id, title, redirect,
    links, abstract_end, categories)`` and texts ``(id, url, title, text)``; each method gives a
    DataFrame and reads no more than its columns and keys need."""

    def __init__(self, spark: SparkSession, root: str, language: str = "en", stop_words: Iterable[str] | None = None, lexicon: Iterable[str] = (), scope: str = "abstract", segmenter: Callable[[str], list[str]] | None = None):
        if language not in ("en", "zh") or scope not in ("abstract", "full"):
            raise ValueError("language is 'en' or 'zh', scope 'abstract' or 'full'")
        self.spark, self.language, self.scope, self.lexicon = spark, language, scope, list(lexicon)
        #: Cuts Chinese text instead of the lexicon; without either an installed one does.
        self.segmenter = segmenter or (tx.installed_segmenter() if language == "zh" and not self.lexicon else None)
        self.catalog = Catalog(spark, f"{root.rstrip('/')}/{language}")
        self.stop = list(stop_words) if stop_words is not None else (tx.STOP_WORDS if language == "en" else tx.STOP_WORDS_ZH)

    # ------------------------------------------------------------ build

    def _word_tokens(self, docs: DataFrame):
        lines = tx.lines(F.col("text")) if self.scope == "full" else tx.abstract_slice(F.col("text"), F.col("abstract_end"))
        return tx.tokens_en(lines, self.stop) if self.language == "en" else tx.tokens_zh(docs, lines, self.lexicon, self.stop, segmenter=self.segmenter)

    @timed
    def build(self, pages: DataFrame, texts: DataFrame, rank_iterations: int | None = None, rank_mode: str = "reference", text_order: Column | None = None, page_order: Column | None = None) -> None:
        """Compute and store all tables; a text without a page record is not indexed.

        Of several rows of one id the last counts, as a later file replaces an earlier: the
        greatest in ``text_order`` or ``page_order``, by default in a column ``file`` if there is
        one, then in all columns. Tables that do not need each other are built at the same time.
        """
        write, read = self.catalog.write, self.catalog.read
        order = lambda df: F.struct(*(["file"] if "file" in df.columns else []), *[c for c in df.columns if c not in ("id", "file")])
        PAGE, TEXT = ["id", "title", "redirect", "links", "abstract_end", "categories"], ["id", "url", "title", "text"]
        last_page, last_text = page_order if page_order is not None else order(pages), text_order if text_order is not None else order(texts)
        extra = lambda df, columns: [c for c in df.columns if c not in columns]
        _together(lambda: write("pages", pages.where("id is not null").select(*PAGE, *extra(pages, PAGE)), last_page), lambda: write("texts", texts.where("id is not null").select(*TEXT, *extra(texts, TEXT)), last_text))
        pages, texts = read("pages"), read("texts")

        def links_() -> None:
            write("resolved", links.resolve_redirects(pages))
            resolved = read("resolved")
            edges = cut(links.link_edges(pages, resolved), "edges")
            nodes = pages.where(target(F.col("redirect")).isNull()).select(F.col("id").alias("doc_id"))
            write("edges", edges)
            write("ranks", links.page_rank(nodes, edges, rank_iterations, rank_mode))
            ends = pages.select(F.col("id").alias("resolved_id"), F.col("title").alias("page_title"))
            write("shown", pages.select("id", F.col("title").alias("asked_title"), target(F.col("redirect")).isNotNull().alias("is_redirect")).join(resolved, "id").join(ends, "resolved_id", "left"))
            write("suggestions", suggest.stored(suggest.title_ranks(pages, resolved, read("ranks"))))

        def words() -> tuple[DataFrame, DataFrame]:
            docs = texts.join(pages.select("id", "abstract_end"), "id").where("text is not null")
            weighted, vocabulary, norms = index.build(docs, self._word_tokens(docs), "id")
            write("terms", vocabulary)
            write("norms", norms)
            return weighted, norms

        def categories() -> None:
            tokens = tx.tokens_category(F.col("categories"), self.stop)
            if self.language == "zh":
                own = F.transform(F.filter(F.coalesce("categories", F.array().cast("array<string>")), tx.has_han), F.trim)
                tokens = tx.tokens_zh(pages, own, self.lexicon, self.stop, lower=False, segmenter=self.segmenter)
            labelled = cut(pages.select("id", tokens.alias("t")).where(F.size("t") > 0), "labelled")
            weighted, _, norms = index.build(labelled, F.col("t"), "id", labelled.count())
            write("category_postings", weighted.join(norms, "doc_id"))
            write("category_norms", norms)
            write("category_vectors", weighted.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("term", "tf_idf"))).alias("weights")))

        titles = lambda: write("title_keys", pages.where("title is not null").select(F.lower("title").alias("key"), "id", "title"))
        _, (weighted, norms), _, _ = _together(links_, words, categories, titles)
        # norm and rank stand beside each posting, so that a search joins nothing
        write("postings", weighted.join(norms, "doc_id").join(read("ranks"), "doc_id", "left"))

    def _shown(self, found: list[tuple], columns: str) -> DataFrame:
        """Documents of a short result list ``(doc_id, ...)``, fetched by id."""
        about = {r.id: r for r in self.catalog.fetch("shown", [r[0] for r in found]).collect()} if found else {}
        rows = [(*r, a.resolved_id, a.asked_title, a.is_redirect, a.page_title) for r in found if (a := about.get(r[0]))]
        wanted = self.spark.createDataFrame(rows, f"{columns}, resolved_id long, asked_title string, is_redirect boolean, page_title string")
        ends = sorted({r[-4] for r in rows if r[-4] is not None})
        body = self.catalog.fetch("texts", ends).select(F.col("id").alias("resolved_id"), F.col("url").alias("text_url"), F.col("title").alias("text_title"), tx.strip_title_header(F.col("text")).alias("body"))
        names = [c.strip().split(" ")[0] for c in columns.split(", ")]
        return lookup.result_documents(wanted.join(F.broadcast(body), "resolved_id", "left"), names, self.language)  # one text a result

    # ------------------------------------------------------------ queries

    @timed
    def search_many(self, queries: DataFrame, k: int = 6) -> DataFrame:
        """Ranked documents of ``(query_id, query)`` with the title hit first: ``query_id,
        doc_id, place, dropped_terms``."""
        words = None
        if self.language == "zh":
            words = tx.tokens_zh(queries, F.array("query"), self.lexicon, (), segmenter=self.segmenter)
        analysed = cut(search.analyse(queries, self.catalog.read("terms"), self.stop, words), "analysed")
        found = search.candidates(search.query_vectors(analysed), self.catalog.read("postings").drop("norm", "rank"))
        top = search.top_k(search.score(found, self.catalog.read("norms"), self.catalog.read("ranks")), k)
        hits = search.exact_titles(queries, self.catalog.read("pages"))
        return search.promote_titles(top, hits, k).join(search.dropped_terms(analysed), "query_id", "left")

    def _words(self, query: str) -> list[str]:
        if self.language == "zh":
            known = frozenset(self.lexicon)
            if self.segmenter:
                return [w.lower() for w in self.segmenter(query) if w.strip()]
            return [w.lower() for w in tx.segment_longest(query, known, max(map(len, known), default=1)) if w.strip()]
        return query.lower().split(" ")

    @timed
    def search(self, query: str, k: int = 6) -> DataFrame:
        """Result documents of one query in order, with dropped terms and the spans to highlight;
        a query with ``*`` or ``?`` is a wildcard search over titles.

        The query's own words are looked up first, so that postings are fetched by term and the
        texts of the ``k`` results by id: scans read what their keys select.
        """
        if search.is_wildcard(query):
            return self.wildcard_search(query, k)
        words = self._words(query)
        asked = self.catalog.fetch("terms", sorted({*words} - {*self.stop})).select("term", "idf", F.lit(None).cast("long").alias("id"))
        titled = self.catalog.fetch("title_keys", [query.lower()]).select(F.lit(None).cast("string").alias("term"), F.lit(None).cast("double").alias("idf"), "id")
        known = asked.unionByName(titled.orderBy("id").limit(1)).collect()  # a row for each word, and the title
        idf = {r.term: r.idf for r in known if r.term is not None}
        kept = [w for w in words if w in idf]
        dropped = [w for w in words if w not in idf]
        found = [r.doc_id for r in search.best_of_query(self.catalog.fetch("postings", sorted(idf)), kept, idf, k).collect()] if kept else []
        title = next((r.id for r in known if r.id is not None), None)
        if title is not None:
            found = [title, *[d for d in found if d != title]][:k]
        shown = self._shown([(d, i + 1, dropped) for i, d in enumerate(found)], "doc_id long, place int, dropped_terms array<string>")
        patterns = [query, *dict.fromkeys(words)]
        return shown.withColumn("bold_range", lookup.highlight(F.col("text"), [p for p in patterns if p])).coalesce(1).sortWithinPartitions("place")  # k rows

    def wildcard_search(self, query: str, k: int = 6) -> DataFrame:
        hits = search.wildcard_titles(self.catalog.read("title_keys"), query, k).orderBy("place").collect()
        shown = self._shown([(r.id, r.place) for r in hits], "doc_id long, place int")
        return shown.withColumn("bold_range", lookup.highlight(F.col("text"), [search.wildcard_pattern(query.lower())], literal=False)).coalesce(1).sortWithinPartitions("place")

    def title_search(self, query: str) -> DataFrame:
        hit = self.catalog.fetch("title_keys", [query.lower()])
        return hit.agg(F.min(F.struct("id", "title")).alias("h")).where("h is not null").select("h.*")

    @timed
    def complete_query(self, query: str, hints: int = 6) -> DataFrame:
        return suggest.complete(self.catalog.read("suggestions"), query, hints)

    @timed
    def recommend_sim_doc(self, doc_id: int, k: int = 5) -> DataFrame:
        """Related documents; a redirect or a page without categories has none, an unknown id is
        an error before any scoring."""
        page = self.catalog.fetch("pages", [doc_id])
        if page.isEmpty():
            raise ValueError(f"no page has id {doc_id}")
        row = self.catalog.fetch("category_vectors", [doc_id]).first()
        own = {w.term: w.tf_idf for w in (row.weights if row else []) if w.term not in {*self.stop}}
        return recommend.related_to(doc_id, own, self.catalog.fetch("category_postings", sorted(own)), k).orderBy("place")

    def find_doc(self, doc_id: int) -> DataFrame:
        return self._shown([(doc_id,)], "doc_id long")

    def links_of(self, doc_id: int) -> DataFrame:
        return lookup.links_of(self.spark.createDataFrame([(doc_id,)], "id long"), self.catalog.fetch("edges", [doc_id]))
