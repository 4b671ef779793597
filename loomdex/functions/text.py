"""Tokens, stop words and text slices as column expressions."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fits_broadcast

# Function words that carry no topic; a longer list is read by read_stop_words().
STOP_WORDS = (
    "a about after all also although an and any are as at be because been before between both but by can could did do does during each few for from had has have he her here him his how i if in "
    "into is it its just many may me might more most much must my no nor not of off on once only or other our out over own same several she should since so some such than that the their them "
    "then there these they this those through to under until up was we were what when where which while who whom why will with would you your"
).split()
STOP_WORDS_ZH = "的 了 和 是 在 与 及 而 也 就 都 不 有 这 那 于 以 为 之 其 或 但".split()

# Fixed value: the 32 ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MAX_EN, MAX_ZH = 30, 15
MOST_STOP_WORDS = 100_000
#: A lexicon of more words is not broadcast: texts meet it in a join.
LEXICON_WORDS = 1_000_000


def read_stop_words(spark: SparkSession, path: str) -> list[str]:
    """Stop words of a file, one per line, without outer white space. Each becomes part of an
    expression, so a file of more than ``MOST_STOP_WORDS`` is refused, not cut."""
    rows = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"[\r\n]", "")).alias("w")).where("w <> ''").distinct()
    words = sorted(r.w for r in rows.limit(MOST_STOP_WORDS + 1).collect())
    if len(words) > MOST_STOP_WORDS:
        raise ValueError(f"{path} has more than {MOST_STOP_WORDS} words; it is no stop list")
    return words


def _in(word: Column, stop: Iterable[str]) -> Column:
    stop = list(stop)
    return F.array_contains(F.array(*map(F.lit, stop)), word) if stop else F.lit(False)


def lines(text: Column) -> Column:
    """The non-empty lines of a text."""
    return F.filter(F.split(text, "\n"), lambda x: x != "")


def abstract_slice(text: Column, abstract_end: Column) -> Column:
    """Lines of the abstract: the title line is skipped, then ``abstract_end`` lines follow, or
    three where it is below 1 or null. Null text gives null."""
    n = F.when(abstract_end >= 1, abstract_end).otherwise(F.lit(3))
    return F.slice(lines(text), F.lit(2), n)


def tokens_en(line_array: Column, stop: Iterable[str] = STOP_WORDS) -> Column:
    """English tokens of lines: joined by blanks, punctuation deleted without a gap, split at
    single blanks, kept if 1..30 ASCII letters and no stop word *before* lower-casing (so "The"
    stays and becomes "the"); positions are those among kept tokens."""
    bare = F.translate(F.array_join(line_array, " "), PUNCTUATION, "")
    kept = F.filter(F.split(bare, " "), lambda w: w.rlike(rf"^[A-Za-z]{{1,{MAX_EN}}}\z") & ~_in(w, stop))
    return F.transform(kept, F.lower)


def tokens_category(categories: Column, stop: Iterable[str] = STOP_WORDS) -> Column:
    """Category tokens: joined and split by blanks, lower-cased first; punctuation and letters of
    any script stay. Null categories count as none."""
    known = F.filter(F.coalesce(categories, F.array().cast("array<string>")), lambda c: c.isNotNull())
    words = F.split(F.lower(F.array_join(known, " ")), " ")
    return F.filter(words, lambda w: (w != "") & (F.length(w) <= MAX_EN) & ~_in(w, stop))


def han_only(text: Column) -> Column:
    """Only ASCII letters, digits and Chinese characters of a text."""
    return F.regexp_replace(text, "[^a-zA-Z0-9一-龥]", "")


def has_han(text: Column) -> Column:
    return text.rlike("[一-龥]")


@functools.cache
def simplified() -> dict[str, str]:
    """The simplified form of each of 3,074 traditional characters, as ICU gives it."""
    lines = Path(__file__).with_name("simplified.txt").read_text("utf-8").splitlines()
    return dict(line.split(" ") for line in lines if not line.startswith("#"))


# Words in which a character of two readings stays as it is (elsewhere 著 becomes 着
# and 乾 becomes 干).
KEPT_WORDS = "著名 著作 著者 著稱 著称 著述 著錄 著录 著書 著书 名著 原著 編著 编著 顯著 显著 土著 巨著 專著 专著 論著 论著 遺著 遗著 合著 譯著 译著 卓著 乾隆 乾坤 乾陵 乾卦".split()
#: Signs that stand for those characters while the others are converted.
KEPT_SIGNS = {"著": "\uf8f0", "乾": "\uf8f1"}


def to_simplified(text: Column, mapping: dict[str, str] | None = None, kept: Iterable[str] | None = None) -> Column:
    """Traditional to simplified characters by a character map, :func:`simplified` unless the
    caller gives one, but for the words ``kept`` (``KEPT_WORDS`` with the full map, none with
    another); line breaks and tabs go. Words that differ as a whole are not replaced."""
    pairs = {a: b for a, b in (simplified() if mapping is None else mapping).items() if len(a) == len(b) == 1}
    for word in (KEPT_WORDS if mapping is None else ()) if kept is None else kept:
        marked = word
        for sign, stand_in in KEPT_SIGNS.items():
            marked = marked.replace(sign, stand_in)
        text = F.replace(text, F.lit(word), F.lit(marked))
    pairs |= {stand_in: sign for sign, stand_in in KEPT_SIGNS.items()} if mapping is None or kept else {}
    ordered = sorted(pairs.items())
    return F.regexp_replace(F.translate(text, "".join(a for a, _ in ordered), "".join(b for _, b in ordered)), "[\n\t]", "")


def segment_longest(text: str, lexicon: frozenset[str], longest: int) -> list[str]:
    """Forward maximum matching: the longest lexicon word at each place, runs of ASCII as one
    word, single characters otherwise."""
    out, i, n = [], 0, len(text)
    while i < n:
        if text[i].isascii():
            j = i
            while j < n and text[j].isascii():
                j += 1
            out.append(text[i:j])
        else:
            j = next((i + k for k in range(min(longest, n - i), 1, -1) if text[i : i + k] in lexicon), i + 1)
            out.append(text[i:j])
        i = j
    return out


def _kept_zh(words: list[str], dropped: frozenset[str], lower: bool) -> list[str]:
    return [w.lower() if lower else w for w in words if w not in dropped and len(w) <= MAX_ZH]


def installed_segmenter() -> Callable[[str], list[str]] | None:
    """The cutter of an installed segmenting library, if there is one."""
    import importlib.util

    return _cut_by_library if importlib.util.find_spec("jieba") else None


def _cut_by_library(text: str) -> list[str]:
    import jieba  # loaded where it runs

    return jieba.lcut(text)


def tokens_zh(df: DataFrame, line_array: Column, lexicon: Iterable[str], stop: Iterable[str] = STOP_WORDS_ZH, lower: bool = True, segmenter: Callable[[str], list[str]] | None = None) -> Column:
    """Chinese tokens of lines: joined without a gap, only letters, digits and Chinese characters,
    cut by a dictionary, stop words and words over 15 characters dropped, lower-cased unless told
    otherwise. The lexicon is broadcast; :func:`with_tokens_zh` takes one of any size. A
    ``segmenter`` cuts instead of the dictionary; without either an installed one is taken."""
    words = frozenset(w for w in lexicon if 1 < len(w) <= MAX_ZH)
    longest = max(map(len, words), default=1)
    segmenter = segmenter or (None if words else installed_segmenter())
    shared = df.sparkSession.sparkContext.broadcast((words, longest, frozenset(stop)))

    @F.pandas_udf("array<string>")
    def cut_words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, size, dropped = shared.value
        for texts in batches:
            yield pd.Series([None if t is None else _kept_zh(segmenter(t) if segmenter else segment_longest(t, known, size), dropped, lower) for t in texts], dtype=object)

    return cut_words(han_only(F.array_join(line_array, "")))


def with_tokens_zh(df: DataFrame, id_col: str, line_array: Column, lexicon: DataFrame, out: str = "t", stop: Iterable[str] = STOP_WORDS_ZH, lower: bool = True, most: int = LEXICON_WORDS) -> DataFrame:
    """``df`` with the tokens of :func:`tokens_zh` in ``out``; ``lexicon`` is ``(w)``, ids are unique.

    Up to ``most`` words (counted) the lexicon is broadcast. A larger one is joined: each text's
    pieces of 2 to 15 Chinese characters meet it by shuffle, and the text is cut by those found,
    which are all that could cut it."""
    known = lexicon.where(F.length("w").between(2, MAX_ZH)).select("w").distinct()
    if fits_broadcast(known, most):
        return df.withColumn(out, tokens_zh(df, line_array, [r.w for r in known.collect()], stop, lower))
    text = df.select(F.col(id_col).alias("_id"), F.explode(F.split(han_only(F.array_join(line_array, "")), "[^一-龥]+")).alias("_run")).where(F.length("_run") > 1)
    pieces = F.flatten(F.transform(F.sequence(F.lit(2), F.least(F.length("_run"), F.lit(MAX_ZH))), lambda n: F.transform(F.sequence(F.lit(1), F.length("_run") - n + 1), lambda i: F.substring("_run", i, n))))
    found = text.select("_id", F.explode(pieces).alias("w")).distinct().join(known, "w").groupBy("_id").agg(F.collect_set("w").alias("_known"))
    dropped = frozenset(stop)

    @F.pandas_udf("array<string>")
    def cut_words(texts: pd.Series, lexicons: pd.Series) -> pd.Series:
        each = ((t, frozenset(() if ws is None else ws)) for t, ws in zip(texts, lexicons))
        return pd.Series([None if t is None else _kept_zh(segment_longest(t, ws, max(map(len, ws), default=1)), dropped, lower) for t, ws in each], dtype=object)

    joined = df.join(found, F.col(id_col) == F.col("_id"), "left")
    return joined.withColumn(out, cut_words(han_only(F.array_join(line_array, "")), F.col("_known"))).drop("_id", "_known")


def strip_title_header(text: Column) -> Column:
    """The text without its leading title line and the blank line after it."""
    return F.regexp_replace(text, r"(?s)^.*?\b[^\n]*\n\n", "")


def snippet(text: Column, size: int = 200) -> Column:
    return F.substring(text, 1, size)
