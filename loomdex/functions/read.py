"""How stored values are read: link targets, index terms, usable index rows, current pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# The characters that Unicode counts as white space.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def target(raw: Column) -> Column:
    """A link target up to the first ``#`` or ``|``, ``_`` as a blank, without outer white
    space; null where nothing is left, so null and empty targets are no reference."""
    named = F.translate(F.substring_index(F.substring_index(raw, "#", 1), "|", 1), "_", " ")
    bare = F.btrim(named, F.lit(WHITE))
    return F.when(bare != "", bare)


def term(raw: Column) -> Column:
    """An index term lower-cased without outer blanks; null where nothing is left."""
    bare = F.lower(F.btrim(raw, F.lit(WHITE)))
    return F.when(bare != "", bare)


def usable_rows(postings: DataFrame) -> DataFrame:
    """``(term, doc_id, n)`` of an index table's rows whose term is not null or blank, whose
    ``doc_id`` is not null and whose ``lc`` has an element, repeats included."""
    n = F.size("lc")  # null and empty lists give -1 or 0 (or null): not usable
    rows = postings.select(term(F.col("term")).alias("term"), "doc_id", n.alias("n"))
    return rows.where(F.col("term").isNotNull() & F.col("doc_id").isNotNull() & (F.col("n") > 0))


def usable(postings: DataFrame) -> DataFrame:
    """:func:`usable_rows` with rows of equal read term and ``doc_id`` as one, the one with most
    positions. An empty table gives no rows."""
    return usable_rows(postings).groupBy("term", "doc_id").agg(F.max("n").alias("n"))


def current_pages(pages: DataFrame) -> DataFrame:
    """One row per page id: the one of latest ``edited_at``, then ``loaded_at`` (null times come
    first). Rows without id are left out; equal times fall to the greater title, then redirect."""
    when = F.struct("edited_at", "loaded_at", F.col("title").alias("t"), F.col("redirect").alias("r"))
    rest = [c for c in pages.columns if c != "id"]
    kept = pages.where(F.col("id").isNotNull())
    return kept.groupBy("id").agg(F.max_by(F.struct(*rest), when).alias("row")).select("id", "row.*")
