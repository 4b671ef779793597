"""Problem 7: occurrences and records of every distinct term, with a mark on those too rare or
too common to be useful.

Method: heavy-light aggregation. Heavy terms are detected by a frequent-items sketch of bounded
size per task, merged; they are given small numbers and broadcast, and each task counts them in
local arrays and sends one array pair, whatever its number of rows. Only rows of the other terms
take part in the shuffle by term, once. The sketch decides where a term is counted, never how
often: both count tables are exact, and together they hold every term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.read import usable_rows
from ..session import cut

#: A term is heavy from this share of its table's rows on, so there are at most 1/share heavy terms.
HEAVY_SHARE = 0.005
#: Terms that a task's sketch follows per 1/share; its error is a small part of the share.
TRACKED = 32


def heavy_terms(rows: DataFrame, share: float = HEAVY_SHARE) -> list[tuple[str, str]]:
    """``(tbl, term)`` of about ``share`` of their table's rows or more, by merged sketches of
    bounded size; at most 1/share of each table. A term missed or named in error costs time only."""
    k = max(1, round(1 / share))
    sketched = rows.groupBy("tbl").agg(F.count(F.lit(1)).alias("total"), F.expr(f"approx_top_k(term, {k}, {TRACKED * k})").alias("top")).collect()  # one row per table
    return [(r.tbl, t.item) for r in sketched for t in r.top if t["count"] >= max(2.0, share * r.total)]


def _local_arrays(size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, occurrences = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b in batches:
            at = b.column(0).to_numpy(zero_copy_only=False)
            n = b.column(1).to_numpy(zero_copy_only=False)
            records += np.bincount(at, minlength=size)
            # exact: whole numbers, unlike the weights of bincount, which are floating
            np.add.at(occurrences, at, n)
        yield pa.RecordBatch.from_pydict({"records": pa.array([records.tolist()], pa.list_(pa.int64())), "occurrences": pa.array([occurrences.tolist()], pa.list_(pa.int64()))})

    return count


def _light(rows: DataFrame) -> DataFrame:
    """Counts of terms that are each a small share of the rows: one shuffle by term, after which a
    term's repeated rows and its records are counted where they lie."""
    each = rows.repartition("tbl", "term").groupBy("tbl", "term", "doc_id").agg(F.max("n").alias("n"))
    return each.groupBy("tbl", "term").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("records"))


def term_frequencies(tables: dict[str, DataFrame], rare_records: int = 2, common_share: float = 0.2, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """``(tbl, term, occurrences, records, mark)`` of each term of each index table.

    ``occurrences`` sums positions, ``records`` counts doc_ids; ``mark`` is ``rare`` up to
    ``rare_records`` records, ``common`` from ``common_share`` of the table's doc_ids on (rare
    wins), else null. Null, blank and repeated rows count as :func:`..functions.read.usable` says;
    empty tables give no rows; extra columns are ignored.
    """
    parts = [usable_rows(df).select(F.lit(name).alias("tbl"), "term", "doc_id", F.col("n").cast("long").alias("n")) for name, df in tables.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = cut(rows, "usable")  # read and cleaned once, used by the sketch and by all counts
    spark = rows.sparkSession
    heavy = sorted(heavy_terms(rows, heavy_share))
    numbers = spark.createDataFrame([(t, w, i) for i, (t, w) in enumerate(heavy)], "tbl string, term string, at int")
    counts = _light(rows.join(F.broadcast(numbers), ["tbl", "term"], "left_anti"))
    if heavy:
        # repeated rows of a heavy term meet by record, so no task has all of a term's rows
        numbered = rows.join(F.broadcast(numbers), ["tbl", "term"]).groupBy("at", "doc_id").agg(F.max("n").alias("n")).select("at", "n")
        arrays = numbered.mapInArrow(_local_arrays(len(heavy)), "records array<long>, occurrences array<long>")
        summed = arrays.select(F.posexplode(F.arrays_zip("records", "occurrences")).alias("at", "c")).groupBy("at").agg(F.sum("c.occurrences").alias("occurrences"), F.sum("c.records").alias("records"))
        counts = counts.unionByName(summed.join(F.broadcast(numbers), "at").select("tbl", "term", "occurrences", "records"))
    docs = {r.tbl: r.docs for r in rows.select("tbl", "doc_id").distinct().groupBy("tbl").agg(F.count(F.lit(1)).alias("docs")).collect()}  # one row per table
    enough = F.lit(False)
    for name, n in docs.items():
        enough = enough | ((F.col("tbl") == name) & (F.col("records") >= common_share * n))
    mark = F.when(F.col("records") <= rare_records, "rare").when(enough, "common")
    return counts.select("tbl", "term", "occurrences", "records", mark.alias("mark"))
