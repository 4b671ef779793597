"""Problem 5: one ranking from several differently scaled scores.

Method: median rank aggregation. Each score is replaced by the item's rank in it (equal values
share their mean rank), so ranges, units and outliers are gone; items are ordered by the weighted
median of their ranks, then by the mean rank, then by identifier.

The median ignores one score of three: an item that leads in two scores and is last in the third
stands before one that is near the top in all. Where every score must have the same say,
:func:`first_items` takes ``by="mean_rank"``, the same ranks ordered by their mean first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.running import HEAVY_ROWS, mean_ranks


def weighted_median(ranks: list[Column], weights: list[float]) -> Column:
    """The smallest rank at which half of the total weight is reached."""
    pairs = F.array_sort(F.array(*[F.struct(r.alias("rank"), F.lit(float(w)).alias("w")) for r, w in zip(ranks, weights)]))
    half = sum(weights) / 2
    start = F.struct(F.lit(0.0).alias("upto"), F.lit(None).cast("double").alias("rank"))
    step = lambda acc, x: F.struct((acc["upto"] + x["w"]).alias("upto"), F.coalesce(acc["rank"], F.when(acc["upto"] + x["w"] >= half, x["rank"])).alias("rank"))
    return F.aggregate(pairs, start, step)["rank"]


def median_ranks(df: DataFrame, group: list[str], item: str, scores: list[str], weights: list[float] | None = None, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """``(group..., item, rank_<score>..., median_rank, mean_rank)``.

    Higher scores are better; null and NaN scores are lowest. Rows with a null group or item are
    left out; of several rows of one item the greatest value of each score counts. Groups may be
    of any size: ranks come from counts of distinct values. An empty table gives no rows; extra
    columns are ignored.
    """
    weights = weights or [1.0] * len(scores)
    if len(weights) != len(scores) or min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("one weight of 0 or more for each score, not all 0")
    whole = [*group, item]
    real = lambda s: F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double"))
    items = df.where(" and ".join(f"`{c}` is not null" for c in whole)).groupBy(*whole).agg(*[F.coalesce(F.max(real(s)), F.lit(float("-inf"))).alias(s) for s in scores])
    entry = F.explode(F.array(*[F.struct(F.lit(i).alias("_score"), (F.col(s) + 0.0).alias("_value")) for i, s in enumerate(scores)]))
    long_ = items.select(*whole, entry.alias("_e")).select(*whole, "_e.*")
    ranks = mean_ranks(long_, [*group, "_score"], "_value", heavy_rows)
    ranked = long_.join(ranks, [*group, "_score", "_value"]).groupBy(*whole).agg(*[F.max(F.when(F.col("_score") == i, F.col("rank"))).alias(f"rank_{s}") for i, s in enumerate(scores)])
    each = [F.col(f"rank_{s}") for s in scores]
    mean = sum((r * w for r, w in zip(each, weights)), F.lit(0.0)) / sum(weights)
    return ranked.withColumns({"median_rank": weighted_median(each, weights), "mean_rank": mean})


def first_items(ranked: DataFrame, group: list[str], item: str, by: str = "median_rank") -> DataFrame:
    """The item that comes first in each group, by ``median_rank`` then ``mean_rank`` or the other
    way round, then by the smallest identifier."""
    if by not in ("median_rank", "mean_rank"):
        raise ValueError("by is 'median_rank' or 'mean_rank'")
    order = F.struct(*(["median_rank", "mean_rank"] if by == "median_rank" else ["mean_rank", "median_rank"]), item)
    return ranked.groupBy(*group).agg(F.min(order)[item].alias(item))
