"""The inverted index: postings with positions, document frequencies, weights, norms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, fits_broadcast


def postings(docs: DataFrame, tokens: Column, id_col: str = "doc_id") -> DataFrame:
    """``(term, doc_id, lc)``: the sorted positions of each token in each document. Partial lists
    are built before the shuffle, which is on term and document, so no common term is one task's."""
    each = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(tokens).alias("pos", "term"))
    return each.groupBy("term", "doc_id").agg(F.sort_array(F.collect_list("pos")).alias("lc"))


def last_per_id(docs: DataFrame, id_col: str, order: Column) -> DataFrame:
    """One row per document: the greatest in ``order``, as a later file replaces an earlier."""
    rest = [c for c in docs.columns if c != id_col]
    return docs.groupBy(id_col).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(id_col, "_row.*")


def terms(index: DataFrame, documents: int) -> DataFrame:
    """``(term, df, idf)`` with idf = log10(N / df) on 4 decimals."""
    counted = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counted.withColumn("idf", F.round(F.log10(F.lit(float(documents)) / F.col("df")), 4))


def weigh(index: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(term, doc_id, lc, tf, tf_idf)``: tf = 1 + log10(n) and tf * idf, each on 4 decimals.
    The vocabulary is broadcast only if its counted size allows."""
    side = F.broadcast if fits_broadcast(vocabulary) else (lambda x: x)
    tf = F.round(1 + F.log10(F.size("lc")), 4)
    joined = index.join(side(vocabulary.select("term", "idf")), "term").withColumn("tf", tf)
    return joined.select("term", "doc_id", "lc", "tf", F.round(F.col("tf") * F.col("idf"), 4).alias("tf_idf"))


def norms(weighted: DataFrame) -> DataFrame:
    """``(doc_id, norm)``: length of each document's weight vector."""
    return weighted.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("tf_idf") * F.col("tf_idf"))).alias("norm"))


def build(docs: DataFrame, tokens: Column, id_col: str = "doc_id", documents: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Weighted postings, vocabulary and norms, each written once. ``documents`` is N; by default
    all documents count, also those without a token."""
    raw = cut(postings(docs, tokens, id_col), "postings")
    n = docs.count() if documents is None else documents
    vocabulary = cut(terms(raw, n), "terms")
    weighted = cut(weigh(raw, vocabulary), "weighted")
    return weighted, vocabulary, cut(norms(weighted), "norms")


def repair(index: DataFrame, key: str = "term", order: Column | None = None) -> DataFrame:
    """Duplicate keys dropped, the first in ``order`` kept, and dense ids ``wi`` given anew in
    the order of the keys. ``order`` is never null; without one any row of a key may stay."""
    first = index.groupBy(key).agg(F.min_by(F.struct(*[c for c in index.columns if c not in (key, "wi")]), order if order is not None else F.lit(0)).alias("_row"))
    return dense_ids(first.select(key, "_row.*"), key, "wi")


def dense_ids(df: DataFrame, key: str, out: str) -> DataFrame:
    """Ids 0, 1, 2, ... in the order of a key without a single-task window: rows are
    range-partitioned, numbered inside their partition and shifted by the sizes before."""
    ranged = cut(df.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return ranged.withColumn("_at", place).join(F.broadcast(before.select("_part", "_before")), "_part").select(*[c for c in df.columns if c != out], (F.col("_at") + F.col("_before")).alias(out))


def vocabulary_stats(index: DataFrame) -> DataFrame:
    """One row: distinct terms, documents, pairs and positions."""
    pairs = index.agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.size("lc")).alias("positions"))
    distinct = lambda c: index.select(c).distinct().agg(F.count(F.lit(1)).alias(f"{c}s"))
    one = F.lit(1).alias("_k")
    return distinct("term").select("*", one).join(distinct("doc_id").select("*", one), "_k").join(pairs.select("*", one), "_k").drop("_k")
