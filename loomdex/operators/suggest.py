"""Completion of a query from titles: by prefix, then by edit distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def title_ranks(pages: DataFrame, resolved: DataFrame, ranks: DataFrame) -> DataFrame:
    """``(id, title, rank)``: a redirect has its target's rank, -1 where the target is missing."""
    joined = pages.select("id", "title").join(resolved, "id", "left").join(ranks.withColumnRenamed("doc_id", "_doc"), F.col("resolved_id") == F.col("_doc"), "left")
    return joined.select("id", "title", F.coalesce("rank", F.lit(-1.0)).alias("rank"))


def stored(ranked: DataFrame) -> DataFrame:
    """:func:`title_ranks` with the lower-case title as ``key``, as a catalog sorts them."""
    return ranked.where("title is not null").select(F.lower("title").alias("key"), "id", "title", "rank")


def complete(titles: DataFrame, query: str, hints: int = 6) -> DataFrame:
    """``(id, title, rank, place)`` of at most ``hints`` suggestions from ``(id, title, rank)``.

    First the titles that begin with the query (the title is lower-cased, the query is not), the
    whole title first, then by rank. What room is left goes to the titles whose beginning of the
    query's length is nearest in edit distance, by rank, unless that distance is 80 % of the
    query's length or more. Shorter titles are never suggested; ties go to the smaller id.

    With a ``key`` column (:func:`stored`) the search by prefix reaches the scan and reads only
    where such titles lie; only if they leave room are all titles compared. Each step gives no
    more than ``hints`` rows to the driver.
    """
    n = len(query)
    head = F.lower(F.substring("title", 1, n))
    long_enough = titles.where(F.length("title") >= n)
    begun = long_enough.where(F.col("key").startswith(query)) if "key" in titles.columns else long_enough
    shown = [F.col("id"), F.col("title"), F.col("rank")]
    found = begun.where(head == query).orderBy((F.length("title") != n), F.desc("rank"), "id").limit(hints).select(*shown).collect()
    room, near = hints - len(found), int(0.8 * n) - 1  # the greatest distance that counts
    if room > 0 and near >= 0:
        distance = F.levenshtein(head, F.lit(query), near)  # -1 beyond it
        apart = long_enough.where(head != query).select(*shown, distance.alias("distance")).where("distance >= 0")
        nearest = apart.orderBy("distance", F.desc("rank"), "id").limit(room).collect()
        found += [r for r in nearest if r.distance == nearest[0].distance]
    return titles.sparkSession.createDataFrame([(r["id"], r.title, r.rank, i + 1) for i, r in enumerate(found)], "id long, title string, rank double, place int")


def with_history(suggestions: DataFrame, history: DataFrame, typed: str) -> DataFrame:
    """Titles suggested and earlier queries that begin with what was typed, each once; blank
    input has neither."""
    if not typed.strip():
        return suggestions.select("title").limit(0)
    return suggestions.select("title").union(history.select("query").where(F.lower("query").startswith(typed.lower()))).distinct()


def shown_hints(hints: DataFrame) -> DataFrame:
    """Hints as a page lists them: sorted, without empty ones and ones with a digit."""
    return hints.where("title <> '' and not title rlike '[0-9]'").orderBy("title")
