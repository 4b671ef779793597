"""Running sums and ranks inside groups of any size.

A plain window sends each group to one task. Here the rows of groups over ``heavy_rows`` are cut
into ranges of their whole order, so that many rows with one time part too; the ranges are summed
apart and the sums of earlier ranges are added as offsets. The ranged rows are written once, so
that a recomputed task sees the same ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, fits_broadcast

HEAVY_ROWS = 250_000


def _null_safe(left: str, right: str, cols: list[str]):
    on = F.lit(True)
    for c in cols:
        on = on & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return on


def running_sum(df: DataFrame, group: list[str], order: list[str], sums: dict[str, str],
                heavy_rows: int = HEAVY_ROWS, ranges: int = 64) -> DataFrame:
    """Add each ``out`` of ``sums = {out: value column}``: the sum of the value over the rows of
    the group up to and including this one in the order of ``order``. Null values count as 0. The
    order columns together should be unique inside a group (else ties share no defined order).
    Groups may be null. An empty input gives an empty output."""
    amounts = {out: F.coalesce(F.col(value), F.lit(0)) for out, value in sums.items()}
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > heavy_rows)
    heavy = cut(sizes.select(*group), "heavy")
    if heavy.isEmpty():
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({out: F.sum(a).over(w) for out, a in amounts.items()})
    side = F.broadcast if fits_broadcast(heavy) else (lambda x: x)
    on = _null_safe("d", "h", group)
    light = df.alias("d").join(side(heavy).alias("h"), on, "left_anti")
    mine = df.alias("d").join(side(heavy).alias("h"), on, "left_semi")
    ranged = cut(mine.repartitionByRange(ranges, *group, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    local = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    per_range = ranged.groupBy(*group, "_range").agg(*[F.sum(a).alias(f"_in_{out}") for out, a in amounts.items()])
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most `ranges` rows
    offsets = cut(per_range.select(*group, "_range", *[F.coalesce(F.sum(f"_in_{out}").over(before), F.lit(0)).alias(f"_before_{out}") for out in sums]), "offsets")
    small = F.broadcast if fits_broadcast(offsets) else (lambda x: x)
    summed = ranged.withColumns({f"_to_{out}": F.sum(a).over(local) for out, a in amounts.items()})
    joined = summed.alias("d").join(small(offsets).alias("o"), _null_safe("d", "o", [*group, "_range"]))
    keep = [F.col(f"d.{c}") for c in df.columns if c not in sums]
    whole = joined.select(*keep, *[(F.col(f"d._to_{out}") + F.col(f"o._before_{out}")).alias(out) for out in sums])
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return light.withColumns({out: F.sum(a).over(w) for out, a in amounts.items()}).select(*whole.columns).unionByName(whole)


def mean_ranks(df: DataFrame, group: list[str], value: str, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """``(group..., value, rank)`` of each distinct value of a group, greatest first: the mean of
    the places its rows take. Rows are counted per distinct value before anything is ordered, so
    a value held by most rows is one row here."""
    counted = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_down", -F.col(value))
    summed = running_sum(counted, group, ["_down"], {"_upto": "_rows"}, heavy_rows)
    return summed.select(*group, value, (F.col("_upto") - (F.col("_rows") - 1) / 2).alias("rank"))
