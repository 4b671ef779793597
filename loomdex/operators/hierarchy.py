"""Parent-child links to full hierarchies (problem 6).

Method: a node's hash makes it a splitter or not; roots and nodes with very many children stop a
walk too. Every node walks to its next stop by pointer doubling, which never passes a stop; the
reduced graph of splitters, about 1/``every`` of the nodes, is solved in the same way; the rest
take root, depth and path from the splitter they reached. Nodes that never meet a stop run into a
cycle without splitters; splitters that never meet a root run into a cycle with splitters.

After round r of doubling every node within 2**r steps of a stop has reached it. If nodes at a
greater distance were left, those at 2**r + 1 ... 2**(r+1) steps would arrive in the next round; a
round in which none arrives therefore proves that all left ones are on or before a cycle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: One node in so many is a splitter; nodes with so many children are stops as well.
EVERY, HUB_CHILDREN = 16, 1_000


def is_splitter(node: Column, every: int = EVERY) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(every)) == 0


def _walk(state: DataFrame, with_path: bool) -> tuple[DataFrame, DataFrame]:
    """Double the pointers of ``(node, ptr, steps, at_stop[, way])`` until all are at a stop or no
    more arrive; gives the arrived and the looping ones."""
    state = cut(state, "walk")
    left = state.where("not at_stop").count()
    while left:
        nxt = state.select(F.col("node").alias("_via"), F.col("ptr").alias("_ptr"), F.col("steps").alias("_steps"), F.col("at_stop").alias("_at"), *([F.col("way").alias("_way")] if with_path else []))
        moving = state.where("not at_stop").join(nxt, F.col("ptr") == F.col("_via")).select(
            "node", F.col("_ptr").alias("ptr"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_at").alias("at_stop"),
            *([F.concat("way", "_way").alias("way")] if with_path else []))
        state = cut(state.where("at_stop").unionByName(moving), "walk")
        now = state.where("not at_stop").count()
        if now == left:
            break
        left = now
    return state.where("at_stop"), state.where("not at_stop")


def resolve(links: DataFrame, node: str = "node", parent: str = "parent", every: int = EVERY, hub_children: int = HUB_CHILDREN, with_path: bool = False) -> DataFrame:
    """``(node, root, depth[, path])`` of each node that has a parent; columns keep these names.

    ``root`` is the last node reached and ``depth`` the steps to it; both are -1, and ``path``
    null, where the way runs into a loop (a node may be its own parent). ``path`` leads from the
    root to the node, both included. Rows with a null node or parent are no link; repeated rows
    count once; if a node has several parents the smallest counts. Other columns are ignored. An
    empty table gives no rows. Nodes and parents are whole numbers.
    """
    edges = cut(links.where(F.col(node).isNotNull() & F.col(parent).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(parent).alias("ptr")), "links")
    hubs = edges.groupBy(F.col("ptr").alias("hub")).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= hub_children).select("hub")
    # every target once, marked: a stop is a root (no parent of its own), a hub or a splitter
    nodes = edges.select("node").withColumn("_inner", F.lit(True))
    targets = edges.select(F.col("ptr").alias("target")).distinct()
    marked = targets.join(nodes, F.col("target") == F.col("node"), "left").join(hubs, F.col("target") == F.col("hub"), "left").select(
        "target", F.col("_inner").isNull().alias("at_root"), (F.col("_inner").isNull() | F.col("hub").isNotNull() | is_splitter(F.col("target"), every)).alias("at_stop"))
    marked = cut(marked, "targets")
    way = [F.array("ptr").alias("way")] if with_path else []
    start = edges.join(marked, F.col("ptr") == F.col("target")).select("node", "ptr", F.lit(1).cast("long").alias("steps"), "at_stop", *way)
    reached, endless = _walk(start, with_path)

    # the reduced graph: stops that have a parent, walking from stop to stop until a root
    roots = marked.where("at_root").select(F.col("target").alias("_root"))
    inner_stops = marked.where("at_stop and not at_root").select(F.col("target").alias("_stop"))
    reduced = reached.join(inner_stops, F.col("node") == F.col("_stop"), "left_semi").join(roots, F.col("ptr") == F.col("_root"), "left").select(
        "node", "ptr", "steps", F.col("_root").isNotNull().alias("at_stop"), *(["way"] if with_path else []))
    # a stop whose own walk was endless has no row here: what leads to it drops out as looping
    solved, _ = _walk(reduced, with_path)

    top = solved.select(F.col("node").alias("_stop"), F.col("ptr").alias("_root"), F.col("steps").alias("_steps"), *([F.col("way").alias("_way")] if with_path else []))
    full = reached.join(roots.withColumnRenamed("_root", "_end"), F.col("ptr") == F.col("_end"), "left").join(top, F.col("ptr") == F.col("_stop"), "left")
    at_root, via = F.col("_end").isNotNull(), F.col("_root").isNotNull()
    path = [F.when(at_root, F.reverse(F.concat(F.array("node"), "way"))).when(via, F.reverse(F.concat(F.array("node"), "way", "_way"))).alias("path")] if with_path else []
    out = full.select("node", F.when(at_root, F.col("ptr")).when(via, F.col("_root")).otherwise(-1).alias("root"),
                      F.when(at_root, F.col("steps")).when(via, F.col("steps") + F.col("_steps")).otherwise(-1).alias("depth"), *path)
    loops = endless.select("node", F.lit(-1).cast("long").alias("root"), F.lit(-1).cast("long").alias("depth"), *([F.lit(None).cast("array<long>").alias("path")] if with_path else []))
    return out.unionByName(loops)


def descendants(paths: DataFrame) -> DataFrame:
    """``(node, descendant, distance)`` from the paths of :func:`resolve`: one row for each proper
    ancestor of each node. Looping nodes have none."""
    steps = paths.where("path is not null").select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("at", "node"))
    return steps.where("at < depth").select("node", "descendant", (F.col("depth") - F.col("at")).alias("distance"))


def loop_ways(links: DataFrame, solved: DataFrame) -> DataFrame:
    """``(node, way)`` of each looping node of :func:`resolve`: its ancestors from its parent on, up
    to and once round the cycle, each once; a node on the cycle is the last of its own way. Ways
    are doubled; where one end's way is complete, the ways that lead there are so too. ``links
    (node, parent)`` are those given to ``resolve``.
    """
    edges = links.where("node is not null and parent is not null").groupBy("node").agg(F.min("parent").alias("end"))
    loops = solved.where("root = -1").select("node")
    state = cut(edges.join(loops, "node", "left_semi").select("node", "end", F.array("end").alias("way"), (F.col("node") == F.col("end")).alias("done")), "loops")
    while state.where("not done").count():
        nxt = state.select(F.col("node").alias("_via"), F.col("end").alias("_end"), F.col("way").alias("_way"), F.col("done").alias("_done"))
        both = state.where("not done").join(nxt, F.col("end") == F.col("_via")).select("node", F.col("_end").alias("end"), F.concat("way", "_way").alias("way"), "_done")
        moved = both.select("node", "end", F.array_distinct("way").alias("way"), (F.col("_done") | (F.size(F.array_distinct("way")) < F.size("way"))).alias("done"))
        state = cut(state.where("done").unionByName(moved), "loops")
    return state.select("node", "way")


def loop_descendants(ways: DataFrame) -> DataFrame:
    """``(node, descendant, distance)`` from :func:`loop_ways`: one row for each other node that a
    looping node's way meets, with the steps to the first meeting."""
    steps = ways.select(F.col("node").alias("descendant"), F.posexplode("way").alias("at", "node"))
    return steps.where("node != descendant").select("node", "descendant", (F.col("at") + 1).cast("long").alias("distance"))
