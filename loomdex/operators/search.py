"""Ranked search over an index, for one query or many at once.

Queries are a small table ``(query_id, query)``; its terms are broadcast against the postings, so
only matching postings are shuffled, once, by query and document. Documents meet their norm and
rank after that, and texts are fetched for the few results alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, _in
from ..session import cut, fits_broadcast


def query_table(spark: SparkSession, queries: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "query_id long, query string")


def analyse(queries: DataFrame, vocabulary: DataFrame, stop: Iterable[str] = STOP_WORDS, words: Column | None = None) -> DataFrame:
    """``(query_id, place, term, idf, kept)`` of each word of each query, lower-cased and split at
    single blanks; a word is kept if it is no stop word and the index has it."""
    split = F.split(F.lower("query"), " ") if words is None else words
    each = queries.select("query_id", F.posexplode(split).alias("place", "term"))
    wanted = cut(each, "words")
    side = F.broadcast if fits_broadcast(wanted) else (lambda x: x)
    found = vocabulary.join(side(wanted.select("term").distinct()), "term", "left_semi").select("term", "idf")
    return wanted.join(found, "term", "left").select("query_id", "place", "term", "idf", (F.col("idf").isNotNull() & ~_in(F.col("term"), stop)).alias("kept"))


def dropped_terms(analysed: DataFrame) -> DataFrame:
    """``(query_id, dropped_terms)`` in the order of the query, repeats included."""
    listed = F.sort_array(F.collect_list(F.when(~F.col("kept"), F.struct("place", "term"))))
    return analysed.groupBy("query_id").agg(F.transform(listed, lambda x: x["term"]).alias("dropped_terms"))


def query_vectors(analysed: DataFrame) -> DataFrame:
    """``(query_id, term, weight, length, bigrams)`` of the kept terms: weight = (1 + log10 count)
    * idf, length of the query's vector, and the query's neighbouring pairs of kept terms."""
    kept = analysed.where("kept")
    per_term = kept.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("c"), F.first("idf").alias("idf"))
    weights = per_term.select("query_id", "term", ((1 + F.log10("c")) * F.col("idf")).alias("weight"))
    whole = kept.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "term"))).alias("w")).withColumn("w", F.transform("w", lambda x: x["term"]))
    pairs = F.filter(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b")), lambda x: x["b"].isNotNull())
    lengths = weights.groupBy("query_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    return weights.join(lengths, "query_id").join(whole.select("query_id", pairs.alias("bigrams")), "query_id")


def best_of_query(postings: DataFrame, words: list[str], idf: dict[str, float], k: int, rank_weight: float = 10_000.0) -> DataFrame:
    """``(doc_id, score)`` of the ``k`` best documents for one query's kept words, as :func:`score`
    has them. ``postings`` are those of the words, each with its document's ``norm`` and ``rank``
    beside it, so they are read, summed by document and ordered without any join."""
    counts = Counter(words)
    weights = {t: (1 + math.log10(c)) * idf[t] for t, c in counts.items()}
    length = math.sqrt(sum(w * w for w in weights.values()))
    weight = F.create_map(*[F.lit(x) for t, w in weights.items() for x in (t, w)])[F.col("term")]
    pairs = [(a, b) for a, b in zip(words, words[1:])]
    entries = [F.map_from_entries(F.collect_list(F.struct("term", "lc"))).alias("at")] if pairs else []  # as many as the query has terms
    per_doc = postings.groupBy("doc_id").agg(F.sum(weight * F.col("tf_idf")).alias("dot"), F.first("norm").alias("norm"), F.first("rank").alias("rank"), *entries)
    places = lambda t: F.coalesce(F.try_element_at(F.col("at"), F.lit(t)), F.array().cast("array<int>"))
    phrase = sum((0.5 * F.size(F.array_intersect(F.transform(places(a), lambda p: p + 1), places(b))) for a, b in pairs), F.lit(0.0))
    vsm = F.coalesce(F.try_divide(F.col("dot") * F.col("dot"), F.lit(length) * F.col("norm")), F.lit(0.0))
    scored = per_doc.select("doc_id", (vsm + rank_weight * F.coalesce("rank", F.lit(0.0)) + phrase).alias("score"))
    return scored.orderBy(F.round("score", 9).desc(), "doc_id").limit(k)


def candidates(vectors: DataFrame, weighted: DataFrame) -> DataFrame:
    """``(query_id, doc_id, dot, phrase, length)`` of each document with any kept term: the dot
    product and half a point for each pair of neighbouring positions of neighbouring terms."""
    vectors = cut(vectors, "vectors")
    side = F.broadcast if fits_broadcast(vectors) else (lambda x: x)
    hits = weighted.join(side(vectors.select("query_id", "term", "weight")), "term")
    entries = F.map_from_entries(F.collect_list(F.struct("term", "lc")))  # as many as the query has terms
    per_doc = hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("tf_idf")).alias("dot"), entries.alias("at"))
    queries = vectors.select("query_id", "length", "bigrams").dropDuplicates(["query_id"])  # its rows agree
    none = F.array().cast("array<int>")
    places = lambda t: F.coalesce(F.try_element_at(F.col("at"), t), none)
    pairs = F.aggregate("bigrams", F.lit(0), lambda acc, b: acc + F.size(F.array_intersect(F.transform(places(b["a"]), lambda p: p + 1), places(b["b"]))))
    return per_doc.join(side(queries), "query_id").select("query_id", "doc_id", "dot", (0.5 * pairs).alias("phrase"), "length")


def score(found: DataFrame, norms: DataFrame, ranks: DataFrame | None = None, rank_weight: float = 10_000.0) -> DataFrame:
    """Add ``vsm`` = dot^2 / (length * norm) and ``score`` = vsm + rank_weight * rank + phrase;
    what cannot be divided counts 0, a document without rank has rank 0."""
    vsm = F.coalesce(F.try_divide(F.col("dot") * F.col("dot"), F.col("length") * F.col("norm")), F.lit(0.0))
    scored = found.join(norms, "doc_id", "left").withColumn("vsm", vsm)
    if ranks is None:
        return scored.withColumn("score", F.col("vsm") + F.col("phrase"))
    return scored.join(ranks, "doc_id", "left").withColumn("score", F.col("vsm") + rank_weight * F.coalesce("rank", F.lit(0.0)) + F.col("phrase"))


def top_k(scored: DataFrame, k: int = 6, by: str = "score", decimals: int = 9) -> DataFrame:
    """The ``k`` best documents per query with their ``place``; ties go to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.round(by, decimals).desc(), F.col("doc_id"))
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def exact_titles(queries: DataFrame, pages: DataFrame) -> DataFrame:
    """``(query_id, id, title)``: the page of smallest id whose title equals the query but for case."""
    small = queries.select("query_id", F.lower("query").alias("_q"))
    side = F.broadcast if fits_broadcast(small) else (lambda x: x)
    hit = pages.select("id", "title").join(side(small), F.lower("title") == F.col("_q"))
    return hit.groupBy("query_id").agg(F.min(F.struct("id", "title")).alias("h")).select("query_id", "h.*")


def promote_titles(top: DataFrame, title_hits: DataFrame, k: int = 6) -> DataFrame:
    """``(query_id, doc_id, place)``: a title hit takes first place; its duplicate leaves, or the
    last result if there is none, so that at most ``k`` remain."""
    hits = title_hits.select("query_id", F.col("id").alias("hit"))
    rest = top.select("query_id", "doc_id", "place").join(hits, "query_id", "left").where("hit is null or hit <> doc_id").select("query_id", "doc_id", "place")
    both = rest.unionByName(hits.select("query_id", F.col("hit").alias("doc_id"), F.lit(0).alias("place")))
    w = Window.partitionBy("query_id").orderBy("place", "doc_id")  # at most k + 1 rows a query
    return both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def wildcard_pattern(query: str) -> str:
    """Regular expression of a query with ``*`` (any run) and ``?`` (one character), neither of
    which crosses a blank or hyphen; all else is literal. A match begins and ends at a word's
    boundary or a hyphen."""
    body = "".join({"*": r"[^\-\s]*", "?": r"[^\-\s]"}.get(c, re.escape(c)) for c in query)
    return "|".join((rf"\b{body}\b", rf"\b{body}\-", rf"\-{body}\b", rf"\-{body}\-"))


def is_wildcard(query: str) -> bool:
    return "*" in query or "?" in query


def wildcard_titles(pages: DataFrame, query: str, k: int = 6) -> DataFrame:
    """``(id, title, distance, place)`` of the titles that match anywhere, whatever their case,
    nearest in edit distance first; ties go to the smaller id."""
    q = query.lower()
    hit = pages.where(F.col("title").rlike("(?iU)" + wildcard_pattern(q))).select("id", "title", F.levenshtein(F.lower("title"), F.lit(q)).alias("distance"))
    best = hit.orderBy("distance", "id").limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy("distance", "id")))
