"""Fields of a wikitext page as column expressions.

What a line-by-line reader would track is stated as positions: the lead ends at the first heading;
an infobox discards what stands before it and is skipped up to the first line ``}}``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First characters of a paragraph of its own, by language.
PARAGRAPH = {"en": "^[a-zA-Z]", "zh": "^[一-龥]"}
NAMESPACES = r"Wikipedia:|MediaWiki:|Help:"


def _first(array: Column, condition) -> Column:
    """Place (from 1) of the first element for which the condition holds, 0 if none."""
    return F.array_position(F.transform(array, lambda x: F.coalesce(condition(x), F.lit(False))), True)


def lead_lines(lines: Column) -> Column:
    """Lines of the lead section, without category lines, empty lines and the infobox."""
    size = F.size(lines)
    category = lambda x: x.startswith("[[Category")
    heading = _first(lines, lambda x: x.startswith("=="))
    end = F.when(heading > 0, heading - 1).otherwise(size)
    box = _first(lines, lambda x: x.contains("{{Infobox") & ~category(x))
    after = F.slice(lines, F.greatest(box, F.lit(1)), size)
    close = _first(after, lambda x: x == "}}")
    start = F.when(box == 0, F.lit(1)).when(close == 0, size + 1).otherwise(box + close - 1)
    return F.filter(F.slice(lines, F.greatest(start.cast("int"), F.lit(1)), F.greatest((end - start + 1).cast("int"), F.lit(0))), lambda x: (x != "") & ~category(x))


def paragraphs(lead: Column, language: str = "en") -> Column:
    """Main paragraphs as one text with ``\\n`` before each; it begins with an empty paragraph to
    which lines that begin none are appended."""
    opened = _first(lead, lambda x: x.rlike(r"^(?:\p{L}|''')"))
    main = F.when(opened > 0, F.slice(lead, F.greatest(opened, F.lit(1)), F.size(lead))).otherwise(F.array().cast("array<string>"))
    shown = F.filter(main, lambda x: ~x.rlike(r"(?d)^<!--.*?-->\z") & ~x.rlike(r"(?d)^\{\{.*?\}\}\z"))
    begins = lambda x: x.rlike(PARAGRAPH[language]) | x.rlike(r"^[{\[(]")
    return F.array_join(F.transform(shown, lambda x: F.when(begins(x), F.concat(F.lit("\n"), x)).otherwise(x)), "")


def link_targets(text: Column) -> Column:
    """Targets of the links of a text: references gone, brackets off, before ``|`` and ``#``."""
    bare = F.regexp_replace(text, r"(?d)<ref.*?</ref>", "")
    found = F.regexp_extract_all(bare, F.lit(r"(?d)(\[\[.*?\]\]?)"), 1)
    return F.transform(found, lambda x: F.split_part(F.split_part(F.regexp_replace(x, r"\[\[|\]\]", ""), F.lit("|"), F.lit(1)), F.lit("#"), F.lit(1)))


def category_names(lines: Column) -> Column:
    named = F.filter(lines, lambda x: x.startswith("[[Category"))
    return F.transform(named, lambda x: F.get(F.split(x, r":|\]\]|\|"), F.lit(1)))


def parse(df: DataFrame, text_col: str, redirect: Column | None = None, language: str = "en") -> DataFrame:
    """Add ``links``, ``abstract_end`` and ``categories``.

    Redirect pages have none of them and end 0, as do pages without a lead. A null text counts as
    such a page; columns of these names are replaced.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    staged = df.withColumn("_lines", lines).withColumn("_lead", lead_lines(F.col("_lines"))).withColumn("_paras", paragraphs(F.col("_lead"), language))
    none = F.array().cast("array<string>")
    plain = F.lit(True) if redirect is None else F.coalesce(redirect == "", F.lit(True))
    linked = F.col("_paras") if language == "en" else F.array_join(F.filter(F.split("_paras", "\n"), lambda p: ~p.contains("[[Category")), "\n")
    count = F.size(F.split(F.col("_paras"), "\n"))
    return staged.withColumns({
        "links": F.when(plain, link_targets(linked)).otherwise(none),
        "abstract_end": F.when(plain & (F.size("_lead") > 0), count).otherwise(0),
        "categories": F.when(plain, category_names(F.col("_lines"))).otherwise(none),
    }).drop("_lines", "_lead", "_paras")


def in_article_space(title: Column) -> Column:
    """Titles outside the project, software and help namespaces."""
    return ~title.rlike(NAMESPACES)


def no_self_redirect(title: Column, redirect: Column) -> Column:
    return ~title.eqNullSafe(redirect)


def plain_text(text: Column) -> Column:
    """Running text of one paragraph: references, templates and tags go, links show their last
    part, quote marks go, and what is left of emptied brackets and doubled blanks is tidied."""
    shown = F.regexp_replace(text, r"(?d)<ref[^>]*/>|<ref.*?</ref>|\{\{[^{}]*\}\}|</?[A-Za-z][^<>]*>|'{2,}", "")
    shown = F.regexp_replace(shown, r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]", "$1")
    shown = F.regexp_replace(shown, r"\([\s,;]*\)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(shown, r"([(,])\s*,+", "$1"), r" {2,}", " "))
