"""The link graph: resolved redirects, edges, page rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.read import target
from ..session import cut
from . import hierarchy


def resolve_redirects(pages: DataFrame) -> DataFrame:
    """``(id, resolved_id)`` of current pages ``(id, title, redirect)``: a real page is itself, a
    redirect is the real page at the end of its way, null where a title on the way is missing or
    the way runs in a circle. Of several pages with one title the smallest id counts."""
    rows = cut(pages.select("id", "title", target(F.col("redirect")).alias("to")), "pages")
    titles = rows.where("title is not null").groupBy("title").agg(F.min("id").alias("parent"))
    links = rows.where("to is not null").select(F.col("id").alias("node"), "to").join(titles, F.col("to") == F.col("title")).select("node", "parent")
    solved = hierarchy.resolve(links)
    real = rows.where("to is null").select("id")
    ends = solved.join(real.withColumnRenamed("id", "_real"), F.col("root") == F.col("_real")).select(F.col("node").alias("id"), F.col("root").alias("resolved_id"))
    known = ends.unionByName(real.select("id", F.col("id").alias("resolved_id")))
    return rows.select("id").join(known, "id", "left")


def link_edges(pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """Distinct ``(src, dst)`` from real pages to the pages their links' titles resolve to; titles
    are matched with case, unknown and unresolved targets are dropped, self-links stay."""
    titles = pages.where("title is not null").groupBy("title").agg(F.min("id").alias("target_id"))
    links = pages.where(target(F.col("redirect")).isNull()).select(F.col("id").alias("src"), F.explode("links").alias("raw")).select("src", target(F.col("raw")).alias("to")).where("to is not null").distinct()
    hit = links.join(titles, F.col("to") == F.col("title")).select("src", "target_id")
    return hit.join(resolved.where("resolved_id is not null"), F.col("target_id") == F.col("id")).select("src", F.col("resolved_id").alias("dst")).distinct()


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("out_degree"))


def page_rank(nodes: DataFrame, edges: DataFrame, iterations: int | None = None, mode: str = "reference", damping: float = 0.85, eps: float = 1e-4, limit: int = 100) -> DataFrame:
    """``(doc_id, rank)`` of ``nodes (doc_id)`` over distinct ``edges (src, dst)`` between them.

    Start is 1/N, the mass of pages without links is spread over all pages. ``reference`` adds
    (1 - damping)/N times the old rank, so mass shrinks; ``standard`` adds (1 - damping)/N.
    With ``iterations`` exactly so many steps are made; else steps go on until the sum of changes
    is below ``eps``, and the vector *before* the last step is the result.
    """
    if mode not in ("reference", "standard"):
        raise ValueError("mode is 'reference' or 'standard'")
    nodes = cut(nodes.select("doc_id").distinct(), "nodes")
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    linked = cut(edges.join(out_degrees(edges), "src").select("src", "dst", "out_degree"), "links")
    ranks = nodes.withColumn("rank", F.lit(1.0 / n)).join(out_degrees(edges).select(F.col("src").alias("doc_id"), F.lit(True).alias("links_out")), "doc_id", "left")
    ranks = cut(ranks, "rank")
    for _ in range(limit if iterations is None else iterations):
        dangling = ranks.where("links_out is null").agg(F.sum("rank")).first()[0] or 0.0
        flow = linked.join(ranks, F.col("src") == F.col("doc_id")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out_degree")).alias("flow"))
        kept = F.col("rank") if mode == "reference" else F.lit(1.0)
        new = damping * (F.coalesce("flow", F.lit(0.0)) + F.lit(dangling / n)) + F.lit((1 - damping) / n) * kept
        step = cut(ranks.join(flow, F.col("doc_id") == F.col("dst"), "left").select("doc_id", new.alias("rank"), "links_out", F.abs(new - F.col("rank")).alias("change")), "rank")
        if iterations is None and (step.agg(F.sum("change")).first()[0] or 0.0) < eps:
            break
        ranks = step.drop("change")
    return ranks.select("doc_id", "rank")
