"""Streams that keep an index and the orphan ledger up to date.

Both are safe to restart: what a micro-batch leaves behind is stored under its number, and a batch
that is run again, as a stream does after a failure, replaces itself instead of being added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as tx
from ..operators import index
from ..operators.orphans import OrphanLedger, span_changes


def append_postings(docs: DataFrame, root: str, checkpoint: str, trigger_once: bool = True) -> StreamingQuery:
    """Append the raw postings of a stream of ``(doc_id, text)`` below ``root``, with the ids of
    the documents of each micro-batch beside them; :func:`read_postings` reads both. Of several
    texts of one id in a batch the greatest stays. Weights are computed from the stored postings,
    as df and N change with every batch."""
    root = root.rstrip("/")

    def add(batch: DataFrame, number: int) -> None:
        known = batch.where("doc_id is not null and text is not null").groupBy("doc_id").agg(F.max("text").alias("text")).persist()
        index.postings(known, tx.tokens_en(tx.lines(F.col("text")))).write.mode("overwrite").parquet(f"{root}/postings/batch={number}")
        known.select("doc_id").write.mode("overwrite").parquet(f"{root}/documents/batch={number}")
        known.unpersist()

    writer = docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if trigger_once else writer).start()


def read_postings(spark: SparkSession, root: str) -> DataFrame:
    """``(term, doc_id, lc)`` of the documents a stream has stored: those of a document sent in
    several batches are the ones of the last, also where its text has no token left."""
    root = root.rstrip("/")
    last = spark.read.schema("doc_id long, batch int").parquet(f"{root}/documents").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    stored = spark.read.schema("term string, doc_id long, lc array<int>, batch int").parquet(f"{root}/postings")
    return stored.join(last, ["doc_id", "batch"], "left_semi").select("term", "doc_id", "lc")


def advance_ledger(events: DataFrame, state: str, checkpoint: str, trigger_once: bool = True) -> StreamingQuery:
    """Feed the ledger stored below ``state`` from a stream of ``(kind, field, src_id, space, key,
    at, begins, ends)``: ``kind`` is ``reference`` (at) or ``span`` (begins, ends), times in
    microseconds. Batches must arrive in order of event time; inside a batch order does not matter.

    Every batch starts from the state as of the batch before it, which is read again only after a
    restart, and stores what it changed together with its number: a batch whose mark is there is
    not taken in again. :meth:`OrphanLedger.load` gives the ledger at any time."""
    spark, state = events.sparkSession, state.rstrip("/")
    held: list = []

    def take(batch: DataFrame, number: int) -> None:
        if not held:
            held.append(OrphanLedger.load(spark, state))
        ledger, last = held[0]
        if number <= last:
            return
        held.clear()  # if this fails, the stored state counts
        batch = batch.persist()
        refs = batch.where("kind = 'reference'").select("field", "src_id", "space", "key", "at")
        changes = span_changes(batch.where("kind = 'span'").select("space", "key", "begins", "ends"))
        as_of = batch.agg(F.max(F.coalesce("at", "ends", "begins"))).first()[0] or 0
        ledger.advance(refs, changes, as_of)
        ledger.save(state, number)
        batch.unpersist()
        held.append((ledger, number))

    writer = events.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if trigger_once else writer).start()
