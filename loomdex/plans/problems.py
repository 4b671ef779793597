"""Queries of the general problems: dangling references, hot keys, hierarchies (3, 4, 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.read import current_pages, target, term
from ..operators import hierarchy, orphans, quantiles
from ..session import cut, spread, table


def page_references(pages: DataFrame) -> DataFrame:
    """``(field, src_id, key, edited_at)`` of each redirect and link of each row with an id."""
    redirects = F.array(F.struct(F.lit("pages.redirect").alias("field"), F.col("redirect").alias("raw")))
    links = F.transform(F.coalesce("links", F.array().cast("array<string>")), lambda x: F.struct(F.lit("pages.links").alias("field"), x.alias("raw")))
    each = pages.where("id is not null").select(F.col("id").alias("src_id"), "edited_at", F.explode(F.concat(redirects, links)).alias("r"))
    return each.select("r.field", "src_id", target(F.col("r.raw")).alias("key"), "edited_at").where("key is not null")


def _ledger(spark: SparkSession, d: str, months: int = 24) -> orphans.OrphanLedger:
    titles = table(spark, d, "titles")
    of_pages = page_references(spread(table(spark, d, "pages").select("id", "redirect", "links", "edited_at"), "id")).select("field", "src_id", F.lit("title").alias("space"), "key", orphans.micros(F.col("edited_at")).alias("at"))
    of_edges = table(spark, d, "edges").where("dst is not null").select(
        F.lit("edges.dst").alias("field"), F.col("src").alias("src_id"), F.lit("id").alias("space"), F.col("dst").cast("string").alias("key"), orphans.micros(F.col("seen_at")).alias("at"))
    begins, ends = orphans.micros(F.col("added_at")).alias("begins"), orphans.micros(F.col("removed_at")).alias("ends")
    spans = titles.select(F.lit("title").alias("space"), F.col("title").alias("key"), begins, ends).unionByName(
        titles.select(F.lit("id").alias("space"), F.col("id").cast("string").alias("key"), begins, ends))
    times = table(spark, d, "pages").select(orphans.micros(F.col("edited_at")).alias("at")).unionByName(table(spark, d, "edges").select(orphans.micros(F.col("seen_at")).alias("at")))
    return orphans.run_ledger(of_pages.unionByName(of_edges), spans, months, times)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = _ledger(spark, d).report(with_open=False)
    return found.select(F.col("field").alias("ref_field"), "src_id", F.col("key").alias("target_key"), "reason", F.col("month").alias("ref_month")).distinct()


def p3_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per field and month of the reference as they stood at the end of each month."""
    day = F.date_from_unix_date((F.col("as_of") / 86_400_000_000).cast("int")).cast("string")
    return orphans.monthly_snapshots(_ledger(spark, d)).select(day.alias("as_of"), "field", "month", "reason", "open", "n")


def keyed_rows(spark: SparkSession, d: str) -> DataFrame:
    """``(key_field, key_value, value)`` of every stored row, link element and edge."""
    postings = table(spark, d, "postings").select(F.lit("postings.term").alias("key_field"), term(F.col("term")).alias("key_value"), F.col("doc_id").alias("value"))
    links = spread(table(spark, d, "pages").select("id", "links"), "id").select(F.lit("pages.links").alias("key_field"), F.explode("links").alias("l"), F.col("id").alias("value")).select("key_field", target(F.col("l")).alias("key_value"), "value")
    edges = table(spark, d, "edges").select(F.lit("edges.dst").alias("key_field"), F.col("dst").cast("string").alias("key_value"), F.col("src").alias("value"))
    return postings.unionByName(links).unionByName(edges)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.hot_keys(keyed_rows(spark, d), ["key_value"], ["key_field"], min_share=0.02).select("key_field", "key_value")


def p4_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Rows and exact quartiles of the referring ids for every term and target."""
    out = quantiles.per_key_quantiles(keyed_rows(spark, d), ["key_field", "key_value"], "value", [0.25, 0.5, 0.75], ["key_field"])
    return out.select("key_field", "key_value", "n", F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"))


def redirect_parents(pages: DataFrame) -> DataFrame:
    """``(node, parent)`` of current pages whose read redirect is the title of a current page;
    of several pages with one title the smallest id counts."""
    now = cut(current_pages(pages.select("id", "title", "redirect", "edited_at", "loaded_at")).select("id", "title", target(F.col("redirect")).alias("to")), "current")
    named = now.where("title is not null").groupBy("title").agg(F.min("id").alias("parent"))
    return now.where("to is not null").select(F.col("id").alias("node"), "to").join(named, F.col("to") == F.col("title")).select("node", "parent")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    solved = hierarchy.resolve(redirect_parents(table(spark, d, "pages")))
    return solved.select(F.col("node").alias("page_id"), F.col("root").alias("root_id"), F.col("depth").alias("node_depth"))


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path (ids joined by ``/``), root, depth and number of descendants of each page with a
    parent, and the number of descendants of each root."""
    solved = cut(hierarchy.resolve(redirect_parents(table(spark, d, "pages")), with_path=True), "paths")
    below = hierarchy.descendants(solved).groupBy("node").agg(F.count(F.lit(1)).alias("descendants"))
    full = solved.join(below, "node", "full")
    return full.select(F.col("node").alias("page_id"), F.coalesce("root", "node").alias("root_id"), F.coalesce("depth", F.lit(0)).alias("node_depth"),
                       F.when(F.col("root") == -1, None).otherwise(F.concat_ws("/", F.coalesce("path", F.array("node")))).alias("path"), F.coalesce("descendants", F.lit(0)).alias("descendants"))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every descendant of every page that has one, with its distance."""
    solved = cut(hierarchy.resolve(redirect_parents(table(spark, d, "pages")), with_path=True), "paths")
    return hierarchy.descendants(solved).select(F.col("node").alias("page_id"), F.col("descendant").alias("descendant_id"), "distance")


def _solved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Paths of pages with a parent, ways of looping ones, and all pairs of both, marked."""
    parents = cut(redirect_parents(table(spark, d, "pages")), "parents")
    solved = cut(hierarchy.resolve(parents, with_path=True), "paths")
    ways = hierarchy.loop_ways(parents, solved)
    pairs = hierarchy.descendants(solved).withColumn("loop", F.lit(False)).unionByName(hierarchy.loop_descendants(ways).withColumn("loop", F.lit(True)))
    return solved, ways, pairs


def p6_pages(spark: SparkSession, d: str) -> DataFrame:
    """Path (ids joined by ``/``), root, depth and number of descendants of every current page. A
    page without a parent is its own root. Where the way runs into a loop, root and depth are -1
    and the path begins at the last page met before one comes again."""
    solved, ways, pairs = _solved(spark, d)
    below = pairs.groupBy("node").agg(F.count(F.lit(1)).alias("descendants"))
    every = table(spark, d, "pages").where("id is not null").select(F.col("id").alias("node")).distinct()
    full = every.join(solved, "node", "left").join(ways, "node", "left").join(below, "node", "left")
    looped = F.reverse(F.concat(F.array("node"), F.array_remove("way", F.col("node"))))
    return full.select(F.col("node").alias("page_id"), F.coalesce("root", "node").alias("root_id"), F.coalesce("depth", F.lit(0)).alias("node_depth"),
                       F.concat_ws("/", F.coalesce("path", F.when(F.col("way").isNotNull(), looped), F.array("node"))).alias("path"),
                       F.coalesce("descendants", F.lit(0)).alias("descendants"), F.col("way").isNotNull().alias("loop"))


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every other page above every page with the steps to it, marked where the way runs into a
    loop; pages of one cycle are descendants of each other."""
    return _solved(spark, d)[2].select(F.col("node").alias("page_id"), F.col("descendant").alias("descendant_id"), "distance", "loop")


QUERIES = {f.__name__: f for f in (p3_found, p3_snapshots, p4_found, p4_quantiles, p6_found, p6_paths, p6_descendants, p6_pages, p6_pairs)}
