"""Queries of the training-data problems 1, 2, 5, 7, 8, 9 and 10."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table
from . import bpe, distinctive, frequency, langid, markup, mixing, ranking
from .sql import SQL


def _documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", *columns), "doc_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    docs = markup.clean_markup(_documents(spark, d, "text").withColumnRenamed("doc_id", "rec_id"))
    entries = table(spark, d, "pages").where("id is not null").select(F.col("id").alias("rec_id"), F.explode("categories").alias("text"))
    # entries without any mark never reach Python; the others are read once per page and entry
    suspect = entries.where(F.col("text").rlike(markup.SUSPECT)).distinct()
    pages = markup.clean_markup(suspect, entries=True)
    marked = F.size("constructs") > 0
    return docs.where(marked).select(F.lit("documents").alias("tbl"), "rec_id").unionByName(pages.where(marked).select(F.lit("pages").alias("tbl"), "rec_id").distinct())


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """Clean text and constructs of every document (``entry`` null) and of every different category
    entry of every page id, marked or not, over all rows of pages."""
    docs = markup.clean_markup(_documents(spark, d, "text").withColumnRenamed("doc_id", "rec_id"))
    each = table(spark, d, "pages").where("id is not null").select(F.col("id").alias("rec_id"), F.explode("categories").alias("text"))
    entries = markup.clean_markup(each.where("text is not null").distinct(), entries=True)
    shown = lambda df, tbl, entry: df.select(F.lit(tbl).alias("tbl"), "rec_id", entry.cast("string").alias("entry"), "clean_text", F.concat_ws(",", "constructs").alias("constructs"))
    return shown(docs, "documents", F.lit(None)).unionByName(shown(entries, "pages", F.col("text")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.top_terms(distinctive.score_terms(table(spark, d, "postings"), "tf_idf")).select("doc_id", "term")


def p2_residuals(spark: SparkSession, d: str) -> DataFrame:
    """Adjusted residual of every term of every page."""
    scored = distinctive.score_terms(table(spark, d, "postings"), "residual")
    return scored.select("doc_id", "term", "n", F.round("weight", 6).alias("weight"))


def p5_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Median and mean rank of every hit."""
    ranked = ranking.median_ranks(table(spark, d, "query_hits"), ["query_id"], "doc_id", ["tf_idf", "pagerank", "phrase"])
    return ranked.select("query_id", "doc_id", "median_rank", F.round("mean_rank", 6).alias("mean_rank"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    ranked = ranking.median_ranks(table(spark, d, "query_hits"), ["query_id"], "doc_id", ["tf_idf", "pagerank", "phrase"])
    return ranking.first_items(ranked, ["query_id"], "doc_id", by="mean_rank")


def _frequencies(spark: SparkSession, d: str) -> DataFrame:
    return frequency.term_frequencies({name: table(spark, d, name) for name in ("postings", "category_postings")})


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _frequencies(spark, d).where("mark is not null").select("tbl", "term", "mark")


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and pages of every term."""
    return _frequencies(spark, d).select("tbl", "term", "occurrences", "records")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(_documents(spark, d, "text")).select("doc_id", "ids")


#: The curriculum of the mix: sources of large shares lean to its beginning, small ones to its end.
LEAN = 0.8


def _mix_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tokens = mixing.token_table(_documents(spark, d, "source", "text"))
    return tokens, mixing.schedules(table(spark, d, "source_targets"), tokens, lean=LEAN)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    tokens, plan = _mix_inputs(spark, d)
    return mixing.report(mixing.place(tokens, plan), plan).where("short").select("source")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every copy of the mix in training order."""
    return mixing.mix(*_mix_inputs(spark, d)).select("doc_id", "source", "pass", "n_tokens", F.round("position", 9).alias("position"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every listed source."""
    tokens, plan = _mix_inputs(spark, d)
    return mixing.report(mixing.place(tokens, plan), plan).select("source", "target_share", "max_passes", "own_tokens", F.round("wanted_tokens", 3).alias("wanted_tokens"), "reached_tokens", "passes_used", "copies", F.round("actual_share", 6).alias("actual_share"), "short")


def _identifier(spark: SparkSession, d: str) -> langid.Identifier:
    return langid.fit(langid.sample_texts(table(spark, d, "documents")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.relabel(_documents(spark, d, "text", "lang"), identifier=_identifier(spark, d))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of one language of every document, with its confidence."""
    read = langid.identify(_documents(spark, d, "text", "lang"), identifier=_identifier(spark, d))
    each = read.select("doc_id", F.posexplode("language.segments").alias("segment", "s"))
    return each.select("doc_id", "segment", "s.start", "s.end", "s.lang", F.round("s.confidence", 4).alias("confidence"))


QUERIES = {f.__name__: f for f in (p1_found, p1_clean, p2_found, p2_residuals, p5_found, p5_ranks, p7_found, p7_counts, p8_ids, p9_found, p9_mix, p9_report, p10_found, p10_segments)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
