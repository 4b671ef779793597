"""Point lookups, result documents and highlighting."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.read import target
from ..functions.text import strip_title_header

PAGE_URL = "https://{language}.wikipedia.org/wiki?curid="


def find_documents(wanted: DataFrame, pages: DataFrame, resolved: DataFrame, texts: DataFrame, language: str = "en") -> DataFrame:
    """Result documents of ``wanted (doc_id, ...)``: ``id, title, url, text, redirect_from,
    page_exist``. Redirects give their target's document and their own title in
    ``redirect_from``; a missing target gives empty fields and ``page_exist`` false; a page
    without a text record gives an empty text and a URL made of its id."""
    asked = pages.select(F.col("id").alias("doc_id"), F.col("title").alias("asked_title"), target(F.col("redirect")).isNotNull().alias("is_redirect")).join(resolved.withColumnRenamed("id", "doc_id"), "doc_id")
    shown = pages.select(F.col("id").alias("resolved_id"), F.col("title").alias("page_title"))
    body = texts.select(F.col("id").alias("resolved_id"), F.col("url").alias("text_url"), F.col("title").alias("text_title"), strip_title_header(F.col("text")).alias("body"))
    joined = wanted.join(asked, "doc_id").join(shown, "resolved_id", "left").join(body, "resolved_id", "left")
    return result_documents(joined, wanted.columns, language)


def result_documents(joined: DataFrame, columns: list[str], language: str = "en") -> DataFrame:
    """The fields of result documents from ``resolved_id, asked_title, is_redirect, page_title,
    text_url, text_title, body``."""
    exists, empty = F.col("resolved_id").isNotNull(), F.lit("")
    return joined.select(
        *columns, F.col("resolved_id").alias("id"),
        F.when(exists, F.coalesce("text_title", "page_title")).otherwise(empty).alias("title"),
        F.when(exists, F.coalesce("text_url", F.concat(F.lit(PAGE_URL.format(language=language)), F.col("resolved_id").cast("string")))).otherwise(empty).alias("url"),
        F.coalesce("body", empty).alias("text"), F.when(F.col("is_redirect"), F.col("asked_title")).otherwise(empty).alias("redirect_from"), exists.alias("page_exist"))


def find_articles(ids: DataFrame, texts: DataFrame, pages: DataFrame) -> DataFrame:
    """``(id, title, url, text, has_text)``: the text record of an id, else its page's fields;
    unknown ids give no row."""
    joined = ids.select("id").join(texts.select("id", F.col("title").alias("t"), "url", "text", F.lit(True).alias("has_text")), "id", "left").join(pages.select("id", F.col("title").alias("p")), "id", "left")
    return joined.where("has_text or p is not null").select("id", F.coalesce("t", "p").alias("title"), "url", "text", F.coalesce("has_text", F.lit(False)).alias("has_text"))


def title_ids(wanted: DataFrame, titles: DataFrame) -> DataFrame:
    return wanted.select("title").join(titles, "title").select("title", "id")


def links_of(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, links)``: sorted distinct targets of each asked page."""
    return ids.select("id").join(edges.where("dst is not null").select(F.col("src").alias("id"), "dst"), "id").groupBy("id").agg(F.sort_array(F.collect_set("dst")).alias("links"))


def find_articles_by_title(wanted: DataFrame, titles: DataFrame, texts: DataFrame, pages: DataFrame) -> DataFrame:
    """:func:`find_articles` of ``wanted (title)``, with case, by the map ``titles (title, id)``;
    adds ``asked``, the title asked for. Unknown titles give no row."""
    asked = title_ids(wanted.where("title is not null").distinct(), titles).withColumnRenamed("title", "asked")
    return asked.join(find_articles(asked.select("id").distinct(), texts, pages), "id")


def links_of_titles(wanted: DataFrame, titles: DataFrame, edges: DataFrame) -> DataFrame:
    """:func:`links_of` of ``wanted (title)``, with case: ``(title, id, links)``."""
    asked = title_ids(wanted.where("title is not null").distinct(), titles)
    return asked.join(links_of(asked.select("id").distinct(), edges), "id").select("title", "id", "links")


def highlight(text: Column, patterns: Iterable[str], literal: bool = True) -> Column:
    """All matches of each pattern in turn as ``array<struct<start, end>>``: literal words at word
    boundaries, whatever their case, or regular expressions as they are. Null text gives null."""
    compiled = [rf"\b{re.escape(p)}\b" if literal else p for p in patterns]

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        regs = [re.compile(p, re.I) for p in compiled]
        for texts in batches:
            yield pd.Series([None if t is None else [{"start": m.start(), "end": m.end()} for r in regs for m in r.finditer(t)] for t in texts], dtype=object)

    return spans(text)


def page_of(results: DataFrame, page: int, size: int = 10, order: str = "place") -> DataFrame:
    """One page (from 1) of ordered results, with the number of pages, int(n / size) + 1. The sort
    keeps no more rows than the pages up to this one hold."""
    n = results.count()
    return results.orderBy(order).offset((page - 1) * size).limit(size).withColumn("pages", F.lit(n // size + 1))
