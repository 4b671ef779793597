"""Problem 2: how distinctive a term is of a record.

Method: correspondence-analysis residuals. With n positions of a term in a record, r and c the
margins of the record and the term and T their total, the expected count is r*c/T and the residual
(n - expected) / sqrt(expected), adjusted by the variance (1 - r/T)(1 - c/T). The same margins also
give the project's tf-idf weight, (1 + log10 n) * log10(N / df) without rounding, which
``weight="tf_idf"`` selects; stored ``tf_idf``, ``idf`` and ``df`` columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.read import usable
from ..session import cut, fits_broadcast


def score_terms(postings: DataFrame, weight: str = "residual") -> DataFrame:
    """``(doc_id, term, n, weight)`` for each usable pair of an index table.

    A record that is the whole collection, or a term that is, has no variance left: its residual
    is 0. Null, blank and repeated rows count as :func:`..functions.read.usable` says; an empty
    table gives no rows; extra columns are ignored.
    """
    if weight not in ("residual", "tf_idf"):
        raise ValueError("weight is 'residual' or 'tf_idf'")
    pairs = cut(usable(postings), "pairs")
    terms = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("c"))
    # a vocabulary of counted size is broadcast; a larger one joins by shuffle
    vocabulary = cut(terms, "vocabulary")
    side = F.broadcast if fits_broadcast(vocabulary) else (lambda x: x)
    known = pairs.join(side(vocabulary), "term")
    if weight == "tf_idf":
        records = pairs.select("doc_id").distinct().count()
        score = (1 + F.log10("n")) * F.log10(F.lit(float(records)) / F.col("df"))
        return known.select("doc_id", "term", "n", score.alias("weight"))
    total = vocabulary.agg(F.sum("c")).first()[0] or 0
    margins = pairs.groupBy("doc_id").agg(F.sum("n").alias("r"))
    t = F.lit(float(total))
    expected = F.col("r") * F.col("c") / t
    spread = F.sqrt(expected * (1 - F.col("r") / t) * (1 - F.col("c") / t))
    score = F.when(spread > 0, (F.col("n") - expected) / spread).otherwise(0.0)
    return known.join(margins, "doc_id").select("doc_id", "term", "n", score.alias("weight"))


def top_terms(scored: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` terms of highest weight per record; weights are compared on 6 decimals, ties go
    to the smaller term by code points. Spark limits each group before its shuffle, so a record
    with very many terms sends few."""
    w = Window.partitionBy("doc_id").orderBy(F.round("weight", 6).desc(), F.col("term"))
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
