"""Sources and sinks: page dumps, text lines, stop words, catalog tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import wikitext
from ..operators.index import last_per_id

PAGE = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("title", T.StringType()),
    T.StructField("redirect", T.StructType([T.StructField("_title", T.StringType())])),
    T.StructField("revision", T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])),
])
#: Extractors write ids as strings or numbers; both are read.
TEXT = T.StructType([T.StructField("id", T.StringType()), T.StructField("url", T.StringType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])


def read_xml_dump(spark: SparkSession, path: str, row_tag: str = "page") -> DataFrame:
    """``(id, title, redirect, text)`` of a page dump; pages without text or malformed are skipped.
    Files are split by the reader, so one large file is many tasks."""
    pages = spark.read.format("xml").option("rowTag", row_tag).option("mode", "DROPMALFORMED").schema(PAGE).load(path)
    return pages.select("id", "title", F.coalesce("redirect._title", F.lit("")).alias("redirect"), F.col("revision.text").alias("text")).where("text is not null")


def write_xml_dump(pages: DataFrame, path: str) -> None:
    """The inverse of :func:`read_xml_dump`; null redirects have no element. ``revision_id`` is
    that of the page's text, the page's own where there is no such column."""
    revision = F.col("revision_id" if "revision_id" in pages.columns else "id").alias("id")
    shaped = pages.select("id", "title", F.when(F.col("redirect") != "", F.struct(F.col("redirect").alias("_title"))).alias("redirect"), F.struct(revision, F.col("text").alias("text")).alias("revision"))
    shaped.write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").mode("overwrite").save(path)


def page_fields(dump: DataFrame, language: str = "en", variants: dict[str, str] | None = None) -> DataFrame:
    """Field records ``(id, title, redirect, links, abstract_end, categories)`` of dump pages:
    project namespaces dropped (English), self-redirects dropped after conversion (Chinese, by ``variants`` or the full character map)."""
    from ..functions.text import to_simplified

    if language == "zh":
        dump = dump.withColumns({c: to_simplified(F.col(c), variants) for c in ("title", "redirect")})
    kept = dump.where(wikitext.in_article_space(F.col("title"))) if language == "en" else dump.where(wikitext.no_self_redirect(F.col("title"), F.col("redirect")))
    return wikitext.parse(kept, "text", F.col("redirect"), language).select("id", "title", "redirect", "links", "abstract_end", "categories")


def read_texts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Text records of JSON lines; ``glob`` chooses files below ``path`` such as ``wiki*``."""
    reader = spark.read.schema(TEXT).option("recursiveFileLookup", "true")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).json(path)
    return rows.withColumn("id", F.expr("try_cast(id as long)"))


def write_chunks(df: DataFrame, path: str, rows_per_file: int = 2_000) -> None:
    df.write.option("maxRecordsPerFile", rows_per_file).mode("overwrite").parquet(path)


def title_shard(title: Column, language: str = "en") -> Column:
    """Shard of a title: its first ASCII letter, or its length up to 20 for Chinese."""
    if language == "zh":
        return F.when(F.length(title) <= 20, F.length(title).cast("string")).otherwise("other")
    first = F.upper(F.substring(title, 1, 1))
    return F.when(first.rlike("^[A-Z]$"), first).otherwise("other")


def write_title_shards(titles: DataFrame, path: str, language: str = "en") -> None:
    """``(title, id)`` in one folder per :func:`title_shard`, of which a lookup reads one."""
    titles.select("title", "id", title_shard(F.col("title"), language).alias("shard")).repartition("shard", "title").write.partitionBy("shard").mode("overwrite").parquet(path)


def title_map(pages: DataFrame) -> DataFrame:
    """``(title, id)``, case-sensitive; of several pages of a title the one loaded last counts."""
    order = F.struct("edited_at", "loaded_at", "id") if {"edited_at", "loaded_at"} <= set(pages.columns) else F.struct("id")
    return pages.where("title is not null and id is not null").groupBy("title").agg(F.max_by("id", order).alias("id"))


class Catalog:
    """Index tables in one folder: sorted by their lookup key, so that a filter on the key prunes
    row groups by their statistics."""

    KEYS = {"postings": "term", "pure_postings": "term", "category_postings": "term", "terms": "term", "titles": "title", "pages": "id", "texts": "id", "edges": "src", "ranks": "doc_id", "norms": "doc_id", "category_norms": "doc_id", "resolved": "id", "title_keys": "key", "shown": "id", "suggestions": "key", "category_vectors": "doc_id"}

    #: What a key held by many rows is cut by, so that its rows are not one task's.
    SECOND = {"postings": "doc_id", "pure_postings": "doc_id", "category_postings": "doc_id", "edges": "dst", "titles": "id", "title_keys": "id", "suggestions": "id"}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._open: dict[str, DataFrame] = {}

    def write(self, name: str, df: DataFrame, last: Column | None = None) -> None:
        """Range-partitioned by key with a bloom filter on it. With ``last`` one row of each key
        stays, the greatest in that order; rows of a key meet in the same exchange."""
        key = self.KEYS[name]
        by = [key, *([self.SECOND[name]] if self.SECOND.get(name) in df.columns and last is None else [])]
        ranged = df.repartitionByRange(*by)
        if last is not None:
            ranged = last_per_id(ranged, key, last).select(*df.columns)
        ranged.sortWithinPartitions(*by).write.option(f"parquet.bloom.filter.enabled#{key}", "true").mode("overwrite").parquet(f"{self.root}/{name}")
        self._open.pop(name, None)

    def read(self, name: str) -> DataFrame:
        """The table; its files are listed once until this catalog writes it again."""
        if name not in self._open:
            self._open[name] = self.spark.read.parquet(f"{self.root}/{name}")
        return self._open[name]

    def load_or_compute(self, name: str, compute) -> DataFrame:
        """The stored table, or ``compute()`` stored on first use."""
        from pyspark.errors import AnalysisException

        try:
            return self.read(name)
        except AnalysisException:
            self.write(name, compute())
            return self.read(name)

    def zone_map(self, name: str) -> DataFrame:
        """Least and greatest key of each file of a table."""
        key = self.KEYS[name]
        return self.read(name).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(key).alias("first"), F.max(key).alias("last"))

    def fetch(self, name: str, keys: list) -> DataFrame:
        """Rows of some keys; the filter is pushed to the scan."""
        return self.read(name).where(F.col(self.KEYS[name]).isin(keys))
