"""Per-key counts and exact quantiles when a few keys hold most rows (problem 4).

Method: distributed exact selection. The values of a hot key are counted in equal cells of the
interval that still holds a wanted rank (partial counts merge on the map side); the cell with that
rank is kept and refined until it is one value. An interval is a prefix of the value's bits, so a
round fixes the next ``log2(bins)`` bits of every open rank and nothing can overflow. No task ever
receives a hot key's values. The other keys have at most ``hot_rows`` rows each and are ordered by
a window.

:func:`hot_keys` finds the keys of at least a share of the rows by the same selection, without
counting all keys: put in the order of a hash of their key, the rows of a key of that share fill
one of the ranks that lie a share apart, so the values at those ranks name every such key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, fits_broadcast

HOT_ROWS, BINS = 50_000, 1_024
#: Bits of the key hash that :func:`hot_keys` selects on; keys that share one are told apart by count.
HASH_BITS = 40
WHOLE = {"tinyint", "smallint", "int", "bigint"}


def _prefix(v: Column, bits: int) -> Column:
    """The value without its lowest ``bits`` bits (a shift by all 64 would be one by none)."""
    return F.shiftright(v, bits) if bits < 64 else F.lit(0).cast("long")


def _refine(values: DataFrame, ranks: DataFrame, keys: list[str], bits: int, bins: int) -> DataFrame:
    """``(keys..., _p, q, _c)``: the value at each rank and the number of rows that hold it.

    ``ranks`` is ``(keys..., _p, _rank, _prefix)``, ranks from 1, ``_prefix`` the one that all
    values of a key share but for their lowest ``bits`` bits; ``values`` is ``(keys..., _v)``
    without nulls."""
    step = max(1, int(math.log2(bins)))
    state = cut(ranks.select(*keys, "_p", "_rank", "_prefix", F.lit(0).cast("long").alias("_c")), "ranks")
    while bits > 0:
        finer = max(0, bits - step)
        open_ = state.select(*keys, "_prefix").distinct()  # the same interval serves all ranks inside it
        side = F.broadcast if fits_broadcast(open_) else (lambda x: x)
        inside = values.withColumn("_prefix", _prefix(F.col("_v"), bits)).join(side(open_), [*keys, "_prefix"])
        histogram = inside.groupBy(*keys, "_prefix", _prefix(F.col("_v"), finer).alias("_cell")).agg(F.count(F.lit(1)).alias("_c"))
        upto = Window.partitionBy(*keys, "_prefix").orderBy("_cell")  # at most `bins` rows
        summed = histogram.withColumn("_upto", F.sum("_c").over(upto))
        hit = state.drop("_c").join(summed, [*keys, "_prefix"]).where("_upto >= _rank and _upto - _c < _rank")
        state = cut(hit.select(*keys, "_p", (F.col("_rank") - (F.col("_upto") - F.col("_c"))).alias("_rank"), F.col("_cell").alias("_prefix"), "_c"), "ranks")
        bits = finer
    return state.select(*keys, "_p", F.col("_prefix").alias("q"), "_c")


def hot_keys(df: DataFrame, keys: list[str], totals_by: list[str], min_share: float, bins: int = BINS, hash_bits: int = HASH_BITS) -> DataFrame:
    """``(totals_by..., keys..., n, total)`` of each key with at least ``min_share`` of the rows
    that have equal ``totals_by`` columns.

    The rows of a key are selected by the hash of the key, never gathered: at most ``1/min_share``
    ranks are open per total, and only keys found at one are counted exactly. Rows with a null in
    one of the columns are left out; repeats count as stored; other columns are ignored; an empty
    table gives no rows.
    """
    if not 0 < min_share <= 1:
        raise ValueError("min_share is above 0 and at most 1")
    whole = [*totals_by, *keys]
    rows = cut(df.select(*whole).where(" and ".join(f"`{k}` is not null" for k in whole)), "keyed")
    totals = cut(rows.groupBy(*totals_by).agg(F.count(F.lit(1)).alias("total")), "totals")
    apart = F.greatest(F.lit(1), F.ceil(F.lit(min_share) * F.col("total"))).cast("long")
    ranks = totals.select(*totals_by, F.posexplode(F.sequence(apart, F.col("total"), apart)).alias("_p", "_rank"), F.lit(0).cast("long").alias("_prefix"))
    hashed = F.shiftrightunsigned(F.xxhash64(*keys), 64 - HASH_BITS)
    found = _refine(rows.select(*totals_by, hashed.alias("_v")), ranks, totals_by, HASH_BITS, bins)
    # a value of fewer rows than lie between two ranks is no key of that share
    full = cut(found.join(totals, totals_by).where(F.col("_c") >= F.lit(min_share) * F.col("total")).select(*totals_by, F.col("q").alias("_v"), "total").distinct(), "full")
    side = F.broadcast if fits_broadcast(full) else (lambda x: x)
    counted = rows.withColumn("_v", hashed).join(side(full), [*totals_by, "_v"]).groupBy(*whole).agg(F.count(F.lit(1)).alias("n"), F.first("total").alias("total"))
    return counted.where(F.col("n") >= F.lit(min_share) * F.col("total"))


def per_key_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], totals_by: list[str] | None = None,
                      min_share: float = 0.0, hot_rows: int = HOT_ROWS, bins: int = BINS) -> DataFrame:
    """``(keys..., n, total, q0, q1, ...)`` for each key with at least ``min_share`` of the rows.

    ``n`` counts all rows of the key, also those with a null value; ``total`` the rows with equal
    ``totals_by`` columns (all rows without them). ``q_i`` is the smallest value at or below which
    at least ``probs[i]`` of the key's non-null values lie (null if it has none). Values are of a
    whole-number type; another is an error, since a cast would cut its fractions. Rows with a null
    in a key column are left out; ties and repeats count as stored; an empty table gives no rows.
    Other columns are ignored.
    """
    kind = df.select(value).schema[0].dataType.simpleString()
    if kind not in WHOLE:
        raise TypeError(f"quantiles are of whole numbers, {value} is {kind}")
    totals_by = totals_by or []
    rows = df.where(" and ".join(f"`{k}` is not null" for k in keys)).select(*keys, F.col(value).cast("long").alias("_v"))
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("_v").alias("_valued"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    stats = cut(stats, "keys")
    if totals_by:
        totals = cut(stats.groupBy(*totals_by).agg(F.sum("n").alias("total")), "totals")
        small = F.broadcast if fits_broadcast(totals) else (lambda x: x)
        with_total = lambda x: x.join(small(totals), totals_by)
    else:
        total = stats.agg(F.sum("n")).first()[0]
        with_total = lambda x: x.withColumn("total", F.lit(total).cast("long"))
    kept = with_total(stats).where(F.col("n") >= F.lit(min_share) * F.col("total"))
    hot = cut(kept.where(F.col("n") > hot_rows), "hot")
    side = F.broadcast if fits_broadcast(hot) else (lambda x: x)
    # keys of few rows: those of `hot_rows` at most, each ordered by its own window
    few = stats.where(F.col("n") <= hot_rows).count()
    parts = []
    if few:
        own = Window.partitionBy(*keys)
        light = rows.join(side(hot.select(*keys)), keys, "left_anti") if min_share == 0 else rows.join(kept.where(F.col("n") <= hot_rows).select(*keys), keys, "left_semi")
        placed = light.select(*keys, "_v", F.row_number().over(own.orderBy(F.col("_v").asc_nulls_last())).alias("_at"), F.count(F.lit(1)).over(own).alias("n"), F.count("_v").over(own).alias("_valued"))
        at = lambda p: F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("_valued")))
        parts.append(placed.groupBy(*keys).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("_at") == at(p), F.col("_v"))).alias(f"q{i}") for i, p in enumerate(probs)]))
    if not hot.isEmpty():
        bits = hot.agg(F.max(F.length(F.bin(F.col("_lo").bitwiseXOR(F.col("_hi")))))).first()[0] or 0
        wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("_p"), F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("_valued"))).cast("long").alias("_rank")) for i, p in enumerate(probs)]))
        ranks = hot.where("_valued > 0").select(*keys, _prefix(F.col("_lo"), bits).alias("_prefix"), wanted.alias("_w")).select(*keys, "_w.*", "_prefix")
        values = cut(rows.where("_v is not null").join(side(hot.select(*keys)), keys, "left_semi"), "hot-values")
        wide = _refine(values, ranks, keys, bits, bins).groupBy(*keys).agg(*[F.max(F.when(F.col("_p") == i, F.col("q"))).alias(f"q{i}") for i in range(len(probs))])
        parts.append(hot.select(*keys, "n").join(wide, keys, "left"))
    named = [*keys, "n", "total", *[f"q{i}" for i in range(len(probs))]]
    if not parts:
        return kept.select(*keys, "n", "total", *[F.lit(None).cast("long").alias(f"q{i}") for i in range(len(probs))])
    return with_total(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).select(*named)
