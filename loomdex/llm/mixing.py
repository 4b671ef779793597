"""Problem 9: mix sources to target weights.

Method: a time-varying curriculum. Over training time 0..1 each source has a weight schedule,
straight between equally spaced knots and scaled so that its integral is the source's target
share. The integral times the size of the mix is the source's cumulative demand of tokens. The
copies of a source's documents, pass after pass in an order of hashes, take up its demand; the
time at which the demand reaches a copy's first token is that copy's position (demand inverted
piece by piece), and the mix is range-sorted by position. A source is repeated at most
``max_passes`` times; what it then lacks is reported, not made up by others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.read import term
from ..operators.running import HEAVY_ROWS, running_sum
from ..session import cut, fits_broadcast
from . import bpe


def token_table(docs: DataFrame, tokenizer: str = "byte_bpe_50k", **kw) -> DataFrame:
    """``(doc_id, source, n_tokens)`` of every document, written once; sources are read
    lower-cased without outer blanks, null text has no tokens."""
    n = F.coalesce(bpe.count_column(docs, F.col("text"), tokenizer, **kw), F.lit(0).cast("long"))
    return cut(docs.select("doc_id", term(F.col("source")).alias("source"), n.alias("n_tokens")), "tokens")


def schedules(targets: DataFrame, tokens: DataFrame, tilt: dict[str, float] | None = None, knots: int = 5, total_tokens: int | None = None, lean: float = 0.0) -> DataFrame:
    """``(source, target_share, max_passes, own_tokens, demand, w, upto)`` per listed source.

    ``w`` has the weights at the knots, ``upto`` the demand in tokens up to each knot. ``tilt``
    (-1..1 by source) lets a weight rise or fall over time: share * (1 + tilt * (2t - 1)); sources
    it does not name take theirs from ``lean`` (0..1): by the order of their shares from -lean, the
    largest, early in the mix, to lean, the smallest, late. Rows
    of ``targets`` without source or share are left out; of several rows of a source the greatest
    share and number of passes count. A source without documents has 0 tokens.
    """
    listed = targets.select(term(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.coalesce(F.col("max_passes"), F.lit(1)).cast("int").alias("max_passes"))
    listed = listed.where("source is not null and target_share is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_passes").alias("max_passes"))
    own = tokens.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("own"))
    known = cut(listed.join(own, "source", "left").select("source", "target_share", "max_passes", F.coalesce("own", F.lit(0)).alias("own_tokens")), "sources")
    total = total_tokens if total_tokens is not None else known.agg(F.sum("own_tokens")).first()[0] or 0
    if not 0 <= lean <= 1:
        raise ValueError("lean lies between 0 and 1")
    by_share = Window.orderBy(F.desc("target_share"), "source")  # one row per listed source
    known = known.withColumn("_lean", F.lit(float(lean)) * (2 * F.percent_rank().over(by_share) - 1)) if lean else known.withColumn("_lean", F.lit(0.0))
    leaning = F.col("_lean")
    for source, t in (tilt or {}).items():
        if not -1 <= t <= 1:
            raise ValueError("tilt lies between -1 and 1")
        leaning = F.when(F.col("source") == source, F.lit(float(t))).otherwise(leaning)
    at = [k / (knots - 1) for k in range(knots)]
    weights = F.array(*[F.col("target_share") * (1 + leaning * (2 * t - 1)) for t in at])
    demand = F.col("target_share") * F.lit(float(total))
    step = 1 / (knots - 1)
    # trapezoids are exact for straight pieces
    area = lambda k: sum(((F.col("w")[i] + F.col("w")[i + 1]) / 2 * step for i in range(k)), F.lit(0.0))
    with_w = known.withColumns({"demand": demand, "w": weights}).drop("_lean")
    whole = F.when(area(knots - 1) > 0, F.col("demand") / area(knots - 1)).otherwise(0.0)
    return with_w.withColumn("upto", F.array(*[area(k) * whole for k in range(knots)])).withColumn("w", F.transform("w", lambda x: x * whole))


def position(tokens_before: Column, w: Column, upto: Column) -> Column:
    """The time at which a source's demand reaches ``tokens_before``: the piece is found in
    ``upto``, then D + w0*x + (w1 - w0)/(2h)*x^2 = c is solved for x in a form stable for w1 = w0."""
    pieces = F.size(upto) - 1
    h = 1.0 / pieces
    i = F.least(F.greatest(F.size(F.filter(upto, lambda u: u <= tokens_before)) - 1, F.lit(0)), pieces - 1)
    w0, w1, c = F.get(w, i), F.get(w, i + 1), tokens_before - F.get(upto, i)
    root = F.sqrt(F.greatest(w0 * w0 + 2 * (w1 - w0) / h * c, F.lit(0.0)))
    x = F.when(w0 + root > 0, 2 * c / (w0 + root)).otherwise(0.0)
    return F.least(i * h + F.least(F.greatest(x, F.lit(0.0)), h), F.lit(1.0))


def place(tokens: DataFrame, plan: DataFrame, heavy_rows: int = HEAVY_ROWS, seed: int = 17) -> DataFrame:
    """``(doc_id, source, pass, n_tokens, position)`` of every copy in the mix, not yet sorted.

    A copy belongs to the mix if its source's demand is not yet met where it begins. Running
    sums inside a source cut large sources into ranges, so no task holds a whole source.
    """
    side = F.broadcast if fits_broadcast(plan) else (lambda x: x)
    hashed = tokens.join(side(plan.select("source")), "source", "left_semi").withColumn("_order", F.xxhash64("doc_id", F.lit(seed)))
    summed = running_sum(hashed, ["source"], ["_order", "doc_id"], {"_upto": "n_tokens"}, heavy_rows)
    rows = summed.join(side(plan.select("source", "max_passes", "own_tokens", "demand", "w", "upto")), "source")
    # passes that can begin before the demand is met, at most max_passes
    passes = F.least(F.col("max_passes"), F.when(F.col("own_tokens") > 0, F.ceil(F.col("demand") / F.col("own_tokens")).cast("int")).otherwise(1))
    copies = rows.withColumn("pass", F.explode(F.when(passes >= 1, F.sequence(F.lit(1), passes))))
    before = (F.col("pass") - 1) * F.col("own_tokens") + F.col("_upto") - F.col("n_tokens")
    kept = copies.withColumn("_before", before.cast("double")).where(F.col("_before") < F.col("demand"))
    return kept.select("doc_id", "source", "pass", "n_tokens", position(F.col("_before"), F.col("w"), F.col("upto")).alias("position"))


def mix(tokens: DataFrame, plan: DataFrame, **kw) -> DataFrame:
    """The placed copies, range-sorted by position."""
    return place(tokens, plan, **kw).orderBy("position", "source", "doc_id", "pass")


def report(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """Per listed source: target and actual share, tokens wanted, reached and owned, passes used,
    and whether it falls short."""
    sums = placed.groupBy("source").agg(F.sum("n_tokens").alias("reached_tokens"), F.max("pass").alias("passes_used"), F.count(F.lit(1)).alias("copies"))
    rows = cut(plan.join(sums, "source", "left").select(
        "source", "target_share", "max_passes", "own_tokens", F.col("demand").alias("wanted_tokens"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("reached_tokens", "passes_used", "copies")]), "report")
    total = rows.agg(F.sum("reached_tokens")).first()[0] or 0
    share = F.col("reached_tokens") / F.lit(float(total)) if total else F.lit(0.0)
    return rows.withColumns({"actual_share": share, "short": F.col("reached_tokens") < F.col("wanted_tokens")})
