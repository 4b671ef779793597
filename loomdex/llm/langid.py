"""Problem 10: missing or wrong language labels and texts of several languages.

Method: one interpolated Kneser-Ney model of characters per language, stored as sorted arrays of
n-gram hashes; the language of lowest length-normalised cross-entropy wins. Held-out sentences
calibrate how sure that is and set, for short and for long units, the cross-entropy beyond which a
unit is in none of the languages (another language, code, noise): such units are ``und``. Rejection
holds at every step, also for texts without a whole sentence.

A model scores words (runs of letters, Chinese runs in pieces) with their boundaries, so a word
scored once is a table row from then on. Models are fitted on the driver on a bounded sample:
at most ``DOCS_PER_LANGUAGE`` documents per label, those of smallest hash, whatever the corpus;
sentences are relabelled by a first model and the final model is fitted on the outcome, which
undoes wrong labels and mixed texts in the sample. All documents are then classified whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ["de", "en", "es", "fr", "zh"]

# Spellings of the language names (codes of two and three letters, names).
SPELLINGS = {
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "en": ["en", "eng", "english"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "zh": ["zh", "zho", "chi", "cmn", "chinese", "中文", "汉语", "漢語", "普通话"],
}

#: Bounds of the sample the models are fitted on: documents of each label, and characters of a
#: document, so that the driver holds 150 MB at most. All documents are classified, and whole.
DOCS_PER_LANGUAGE, SAMPLE_CHARS = 300, 100_000
ORDER, DISCOUNT, ALPHABET = 4, 0.75, 30_000
#: Words longer than this are scored in pieces; so many word scores are kept per worker.
PIECE, CACHED_WORDS = 12, 500_000
#: A unit of fewer letters (Chinese characters count threefold) is no sentence, nor is one without
#: a closing mark and with fewer than OPEN_LETTERS, such as a heading or a list item.
LEAST_LETTERS, OPEN_LETTERS = 15, 60
#: A unit read with less (calibrated) confidence is rejected: names alone fit several languages.
LEAST_CONFIDENCE = 0.9
#: The limit of rejection lies beyond the cross-entropy of all but 1 % of the held-out sentences by
#: so many times the distance from their median; units of fewer letters have a limit of their own.
TAIL, SHORT = 1.5, 40
#: A rejected unit is read again without words of unknown signs, of at most this share of its letters.
DAMAGE = 0.15
#: The confidence is calibrated on so many words of held-out sentences at a time.
PIECE_WORDS = 3
#: What is in none of the languages.
UNKNOWN = "und"
#: A language counts if so large a share of the sentences is in it.
LEAST_SHARE = 0.2


def canonical_label(label: Column) -> Column:
    """The code a label names, whatever its spelling or region; null if it names none of ours."""
    known = F.split(F.lower(F.trim(label)), "[-_ ]", 2).getItem(0)
    pairs = [F.lit(x) for code, names in SPELLINGS.items() for name in names for x in (name, code)]
    return F.create_map(*pairs)[known]


# ---------------------------------------------------------------- units and words

_MARKED = re.compile(
    r"```.*?(?:```|\Z)|<(syntaxhighlight|pre|code|math|style|script|head)\b[^<>]*>.*?(?:</\1\s*>|\Z)|<ref\b[^<>]*>.*?</ref>|<!--.*?-->|\\begin\{(verbatim|equation|lstlisting)\}.*?(?:\\end\{\2\}|\Z)"
    r"|\{\{(?!lang\|)[^{}]*\}\}|\$\$.*?\$\$|\]\([^()\s]*\)|\\(?:footnote|cite|ref|href|section|subsection|begin|end)\*?\{[^{}\n]*\}|</?[A-Za-z][^<>\n]{0,500}>|&#?\w{1,10};|https?://\S+|\\[A-Za-z]+|\{\{lang\|[a-z]+\||\[\[(?:Category|File):[^\]\n]*\]\]",
    re.S | re.I,
)
_UNIT = re.compile(r"[^.!?。！？\n]+(?:\.(?=[a-z0-9])[^.!?。！？\n]*)*[.!?。！？]*[»”\"』」]*")
_CLOSED = re.compile(r"[.!?。！？]\W*\Z")
_WORD = re.compile(r"[^\W\d_]+")
_HAN = re.compile(r"[㐀-鿿]")
_NOT_HAN = re.compile(r"[^㐀-鿿]+|[㐀-鿿]+")


def units(text: str) -> list[tuple[int, int]]:
    """Offsets of the sentences and lines of a text, markup blanked out but offsets kept."""
    return [m.span() for m in _UNIT.finditer(blank_markup(text))]


def blank_markup(text: str) -> str:
    if not any(c in text for c in "<{\\`&$]") and "http" not in text:
        return text
    return _MARKED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def words(unit: str) -> list[str]:
    """Lower-case words; Chinese and other letters part, long words are cut into pieces."""
    out: list[str] = []
    for w in _WORD.findall((unit if unit.isascii() else unicodedata.normalize("NFKC", unit)).lower()):
        if len(w) <= PIECE and (w.isascii() or not _HAN.search(w)):
            out.append(w)
            continue
        for part in _NOT_HAN.findall(w):
            size = 4 if _HAN.match(part) else PIECE
            out += [part[i : i + size] for i in range(0, len(part), size)]
    return out


def _letters(ws: list[str]) -> int:
    return sum(len(w) * (3 if "㐀" <= w[0] <= "鿿" else 1) for w in ws)


# ---------------------------------------------------------------- models

_MULT = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def _mix(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ code) * _MULT
        return h ^ (h >> _SHIFT)


def _grams(tokens: list[str], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For each character of each word and its end: owner, place, and per order n the hashes of
    the n-gram that ends there and of its context (zero where the word is too short)."""
    text = "".join("\x02" + t + "\x03" for t in tokens)
    code = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter((len(t) + 2 for t in tokens), np.int64, len(tokens))
    owner = np.repeat(np.arange(len(tokens)), sizes)
    place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = place > 0  # the opening mark is context only
    grams, contexts = [], []
    for n in range(1, order + 1):
        h = np.full(len(code), n, np.uint64)
        context = h
        for back in range(n - 1, -1, -1):
            moved = np.concatenate([np.zeros(back, np.uint64), code[: len(code) - back]]) if back else code
            if back == 0:
                context = h
            h = _mix(h, moved)
        whole = place >= n - 1
        grams.append(np.where(whole, h, 0)[keep])
        contexts.append(np.where(whole, context, 0)[keep])
    return owner[keep], place[keep], grams, contexts


class KneserNey:
    """Sorted hash arrays: per order the n-grams with their interpolated probability and the
    contexts with the weight that passes to the shorter context."""

    def __init__(self, counts: Counter, order: int = ORDER, discount: float = DISCOUNT, alphabet: int = ALPHABET):
        tokens = sorted(counts)
        owner, _, grams, contexts = _grams(tokens, order) if tokens else (np.zeros(0, int), None, [np.zeros(0, np.uint64)] * order, [np.zeros(0, np.uint64)] * order)
        weight = np.array([counts[t] for t in tokens], np.float64)[owner] if tokens else np.zeros(0)
        self.order, self.floor = order, 1.0 / alphabet
        self.keys, self.probs, self.context_keys, self.context_weights = [], [], [], []
        lower = None  # probability of the shorter n-gram, at each place
        for n in range(1, order + 1):
            g, c = grams[n - 1], contexts[n - 1]
            there = g != 0
            # raw counts at the highest order and at a word's beginning, where nothing is to the
            # left; else the number of different left neighbours
            if n == order:
                keys, at = np.unique(g[there], return_inverse=True)
                amount = np.bincount(at, weights=weight[there]) if len(keys) else np.zeros(0)
            else:
                wider = grams[n]
                begins = np.flatnonzero(there & (wider == 0))
                inner = np.flatnonzero(there & (wider != 0))
                inner = inner[np.unique(wider[inner], return_index=True)[1]]
                mine = np.concatenate([begins, inner])
                each = np.concatenate([weight[begins], np.ones(len(inner))])
                keys, at = np.unique(g[mine], return_inverse=True)
                amount = np.bincount(at, weights=each) if len(keys) else np.zeros(0)
            place_of = np.searchsorted(keys, g)
            place_of = np.minimum(place_of, max(0, len(keys) - 1))
            # totals and types of each context
            rep = np.zeros(len(keys), np.int64)
            if len(keys):
                rep[place_of[there][::-1]] = np.flatnonzero(there)[::-1]
            context_keys, of = np.unique(c[rep], return_inverse=True) if len(keys) else (np.zeros(0, np.uint64), np.zeros(0, int))
            totals = np.bincount(of, weights=amount) if len(keys) else np.zeros(0)
            kinds = np.bincount(of) if len(keys) else np.zeros(0)
            passed = discount * kinds / np.maximum(totals, 1e-9)
            base = np.full(len(keys), self.floor) if lower is None else lower[rep]
            prob = np.maximum(amount - discount, 0) / np.maximum(totals[of], 1e-9) + passed[of] * base if len(keys) else np.zeros(0)
            self.keys.append(keys)
            self.probs.append(prob)
            self.context_keys.append(context_keys)
            self.context_weights.append(passed)
            shorter = np.full(len(g), self.floor) if lower is None else lower
            lower = self._step(n, g, c, shorter) if len(g) else np.zeros(0)

    def _step(self, n: int, g: np.ndarray, c: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Probability at order n: the stored one, or the shorter one's share of its context."""
        if not len(self.keys[n - 1]):
            return shorter
        at = np.minimum(np.searchsorted(self.keys[n - 1], g), len(self.keys[n - 1]) - 1)
        seen = (self.keys[n - 1][at] == g) & (g != 0)
        of = np.minimum(np.searchsorted(self.context_keys[n - 1], c), len(self.context_keys[n - 1]) - 1)
        known = (self.context_keys[n - 1][of] == c) & (g != 0)
        return np.where(seen, self.probs[n - 1][at], np.where(known, self.context_weights[n - 1][of] * shorter, shorter))

    def surprise(self, owner: np.ndarray, grams: list[np.ndarray], contexts: list[np.ndarray], size: int) -> np.ndarray:
        """Negative log-probability of each word."""
        p = np.full(len(owner), self.floor)
        for n in range(1, self.order + 1):
            p = self._step(n, grams[n - 1], contexts[n - 1], p)
        return np.bincount(owner, weights=-np.log(np.maximum(p, 1e-12)), minlength=size)


class Identifier:
    """Models of all languages with the scores of the words seen so far. ``limits`` holds the limit
    of rejection of each language, for short units and for long ones."""

    def __init__(self, models: list[KneserNey], limits: np.ndarray, sharpness: float):
        self.models, self.limits, self.sharpness = models, limits, sharpness
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(models) + 1))
        #: Measured on the held-out sentences by :func:`fit`.
        self.calibration: dict[str, float] = {}

    def _learn(self, new: list[str]) -> None:
        owner, _, grams, contexts = _grams(new, ORDER)
        scores = np.stack([m.surprise(owner, grams, contexts, len(new)) for m in self.models] + [np.array([len(w) + 1 for w in new], float)], axis=1)
        start = len(self.rows)
        while start + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[start : start + len(new)] = scores
        self.rows.update(zip(new, range(start, start + len(new))))

    def score(self, units_words: list[list[str]]) -> np.ndarray:
        """Cross-entropy per character of each unit under each language (inf without words)."""
        if len(self.rows) > CACHED_WORDS:
            self.rows.clear()
        rows = self.rows
        new = {w for ws in units_words for w in ws if w not in rows}
        if new:
            self._learn(sorted(new))
        at = np.fromiter((rows[w] for ws in units_words for w in ws), np.int64)
        sizes = np.fromiter((len(ws) for ws in units_words), np.int64, len(units_words))
        out = np.full((len(units_words), len(self.models)), np.inf)
        full = sizes > 0
        if full.any():
            starts = (np.cumsum(sizes) - sizes)[full]
            sums = np.add.reduceat(self.table[at], starts, axis=0)
            out[full] = sums[:, :-1] / sums[:, -1:]
        return out

    def without_damage(self, ws: list[str]) -> np.ndarray:
        """As :meth:`score` for one unit just scored, without the words of signs the best language
        does not know, up to ``DAMAGE`` of its letters: stray signs inside a sentence."""
        scores = self.table[[self.rows[w] for w in ws]]
        best = scores[:, :-1].sum(axis=0).argmin()
        each = scores[:, best] / scores[:, -1]
        order = np.argsort(-each)
        lost = np.cumsum(scores[order, -1]) <= DAMAGE * scores[:, -1].sum()
        kept = order[~(lost & (each[order] > 0.5 * math.log(ALPHABET)))]
        return scores[kept, :-1].sum(axis=0) / scores[kept, -1].sum()

    def decide(self, entropy: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language (-1: rejected) of each unit, and the confidence of that language (0 if
        rejected)."""
        best = entropy.argmin(axis=1) if len(entropy) else np.zeros(0, int)
        low = entropy[np.arange(len(best)), best]
        fine = np.isfinite(low)
        gap = np.where(np.isfinite(entropy), entropy - np.where(fine, low, 0)[:, None], np.inf)
        share = np.exp(-gap * self.sharpness * np.minimum(letters, 200)[:, None])
        confidence = np.where(fine, 1 / np.maximum(share.sum(axis=1), 1), 0.0)
        limit = self.limits[(letters >= SHORT).astype(int), best]
        rejected = ~fine | (low > limit) | (confidence < LEAST_CONFIDENCE)
        return np.where(rejected, -1, best), np.where(rejected, 0.0, confidence)


def fit(samples: dict[str, list[str]]) -> Identifier:
    """Fit on texts by label: a first model from the labels, then the final one from sentences as
    the first reads them. A tenth of the sentences is held out to set the limit of rejection and
    the sharpness of the confidence."""
    sentences = []
    for k, lang in enumerate(LANGUAGES):
        for text in samples.get(lang, []):
            shown = blank_markup(text)
            for a, b in ((m.start(), m.end()) for m in _UNIT.finditer(shown)):
                ws = words(shown[a:b])
                if _letters(ws) >= LEAST_LETTERS:
                    sentences.append((k, ws))
    labels = np.array([k for k, _ in sentences], int)
    bags = [ws for _, ws in sentences]
    none = np.full((2, len(LANGUAGES)), np.inf)

    def train(which: np.ndarray) -> list[KneserNey]:
        counts = [Counter() for _ in LANGUAGES]
        for k, ws in zip(which, bags):
            if k >= 0:
                counts[k].update(ws)
        return [KneserNey(c) for c in counts]

    for _ in range(2):  # relabel twice: the second time by models of clean sentences
        first = Identifier(train(labels), none, 1.0)
        entropy = first.score(bags)
        labels = entropy.argmin(axis=1) if len(bags) else labels
    held = np.arange(len(bags)) % 10 == 9
    final = Identifier(train(np.where(held, -1, labels)), none, 1.0)
    test = final.score([b for b, h in zip(bags, held) if h])
    truth = labels[held]
    letters = np.array([_letters(b) for b, h in zip(bags, held) if h], float)
    limits = np.full((2, len(LANGUAGES)), math.log(ALPHABET))
    for k in range(len(LANGUAGES)):
        for long_ in (1, 0):
            mine = test[(truth == k) & ((letters >= SHORT) == bool(long_)), k]
            if len(mine) >= 20:
                high = np.quantile(mine, 0.99)
                limits[long_, k] = high + TAIL * (high - np.median(mine))
            elif not long_ and len(test):  # too few to tell: a unit more than long ones
                limits[0, k] = limits[1, k] + 1
        limits[0, k] = max(limits[0, k], limits[1, k])
    final.limits = limits
    # whole sentences are easy: how far a small lead can be trusted shows on pieces of them
    parts = [(k, b[i : i + PIECE_WORDS]) for k, b in zip(truth, [b for b, h in zip(bags, held) if h]) for i in range(0, len(b), PIECE_WORDS)]
    if parts:
        truths = np.array([k for k, _ in parts])
        pieces = final.score([p for _, p in parts])
        sizes = np.array([_letters(p) for _, p in parts], float)
    least = np.inf
    for s in np.geomspace(0.002, 1.0, 19):
        if parts:
            z = -pieces * s * np.minimum(sizes, 200)[:, None]
            z = z - z.max(axis=1, keepdims=True)
            loss = float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truths]).mean())
            if loss < least - 1e-9:
                final.sharpness, least = float(s), loss
    if len(truth):
        read, sure = final.decide(test, letters)
        kept = read >= 0
        right = (read == truth)[kept]
        which = np.minimum((sure[kept] * 10).astype(int), 9)
        gaps = [abs(right[which == j].mean() - sure[kept][which == j].mean()) * (which == j).sum() for j in set(which.tolist())]
        final.calibration = {"sentences": len(truth), "log_loss": least, "rejected": float(1 - kept.mean()), "accuracy": float(right.mean()) if len(right) else 0.0, "calibration_error": float(sum(gaps) / max(1, kept.sum()))}
    return final


def sample_texts(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> dict[str, list[str]]:
    """At most ``per_language`` texts of each label, those of smallest hash of the id. Only ids
    are ordered; the texts are fetched for the chosen ids alone, but for those longer than
    ``SAMPLE_CHARS``, which are no part of the sample."""
    labelled = docs.select("doc_id", canonical_label(F.col("lang")).alias("label")).where("label is not null and doc_id is not null")
    order = F.xxhash64("doc_id")
    chosen = None
    for lang in LANGUAGES:
        top = labelled.where(F.col("label") == lang).orderBy(order, "doc_id").limit(per_language)
        chosen = top if chosen is None else chosen.unionByName(top)
    ids = {r.doc_id: r.label for r in chosen.collect()}  # at most 5 x per_language rows
    wanted = docs.where(F.col("doc_id").isin(list(ids)) & (F.length("text") <= SAMPLE_CHARS)).select("doc_id", "text")
    out: dict[str, list[str]] = {lang: [] for lang in LANGUAGES}
    for r in sorted(wanted.collect()):
        out[ids[r.doc_id]].append(r.text)
    return out


# ---------------------------------------------------------------- the operator

RESULT = "langs array<string>, shares array<double>, segments array<struct<start:int,end:int,lang:string,confidence:double>>"


def read_texts(identifier: Identifier, texts: list[str | None]) -> list[tuple[list[str], list[float], list[dict]]]:
    """Languages of a fifth of the sentences or more, their shares, and the stretches of one
    language, of each text; stretches in none of the languages are ``und`` with confidence 0, and
    a text of which no fifth is in one of them has no language. Units too short to be sentences
    decide only where a text has no others; a text without letters has no language."""
    spans, bags, owner, closed = [], [], [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        shown = blank_markup(text)
        for m in _UNIT.finditer(shown):
            ws = words(m[0])
            if ws:
                spans.append(m.span())
                bags.append(ws)
                owner.append(i)
                closed.append(_CLOSED.search(m[0]) is not None)
    entropy = identifier.score(bags)
    letters = np.array([_letters(b) for b in bags], float)
    whole = (letters >= LEAST_LETTERS) & (np.array(closed, bool) | (letters >= OPEN_LETTERS))
    lang, sure = identifier.decide(entropy, letters)
    again = np.flatnonzero((lang < 0) & (letters >= LEAST_LETTERS))
    if len(again):
        lang[again], sure[again] = identifier.decide(np.stack([identifier.without_damage(bags[j]) for j in again]), letters[again])
    out: list[tuple[list[str], list[float], list[dict]]] = [([], [], []) for _ in texts]
    at = 0
    while at < len(owner):
        end = at
        while end < len(owner) and owner[end] == owner[at]:
            end += 1
        k = slice(at, end)
        read, trust = lang[k], sure[k]
        counted = whole[k]
        if not counted.any():  # no sentence: the longer lines
            counted = letters[k] >= LEAST_LETTERS
        if not counted.any():  # neither: all units together, as one
            size = letters[k].sum()
            one, trust_in = identifier.decide(((entropy[k] * letters[k][:, None]).sum(axis=0) / max(size, 1.0))[None, :], np.array([size]))
            read, trust, counted = np.full(end - at, one[0]), np.full(end - at, trust_in[0]), np.ones(end - at, bool)
        votes = np.bincount(read[counted] + 1, minlength=len(LANGUAGES) + 1)
        share = votes[1:] / votes.sum()
        kept = [j for j in np.argsort(-share, kind="stable") if share[j] >= LEAST_SHARE]
        segments: list[dict] = []
        weight = 0.0
        for j in np.flatnonzero(counted):
            a, b = spans[at + j]
            name, c, w = LANGUAGES[read[j]] if read[j] >= 0 else UNKNOWN, float(trust[j]), float(letters[at + j])
            if segments and segments[-1]["lang"] == name:
                last = segments[-1]
                last["confidence"] = (last["confidence"] * weight + c * w) / max(weight + w, 1e-9)
                last["end"], weight = b, weight + w
            else:
                segments.append({"start": a, "end": b, "lang": name, "confidence": c})
                weight = w
        out[owner[at]] = ([LANGUAGES[j] for j in kept], [float(share[j]) for j in kept], segments)
        at = end
    return out


def identify(docs: DataFrame, text_col: str = "text", identifier: Identifier | None = None, per_language: int = DOCS_PER_LANGUAGE, out_col: str = "language") -> DataFrame:
    """Add ``out_col`` (:data:`RESULT`): the languages of each text by share of its sentences and
    its stretches with character offsets, language and confidence.

    Null, empty and letterless texts get empty lists. Without an ``identifier`` one is fitted on
    a bounded sample of ``doc_id, text, lang`` of the same table. A column named like the output
    is replaced, all others are kept; an empty table gives no rows.
    """
    spark = docs.sparkSession
    identifier = identifier or fit(sample_texts(docs, per_language))
    # a few MB, bounded by the sample
    shared = spark.sparkContext.broadcast((identifier.models, identifier.limits, identifier.sharpness))

    @F.pandas_udf(RESULT)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        mine = Identifier(*shared.value)
        for texts in batches:
            rows = []
            for k in range(0, len(texts), 512):
                rows += read_texts(mine, texts.iloc[k : k + 512].tolist())
            yield pd.DataFrame(rows, columns=["langs", "shares", "segments"])

    return docs.withColumn(out_col, read(F.col(text_col)))


def relabel(docs: DataFrame, **kw) -> DataFrame:
    """``(doc_id, lang)`` of documents whose label is missing, names another language than the
    text's, or whose text mixes languages (then always): one row per language of the text."""
    read = identify(docs.select("doc_id", "text", "lang"), **kw)
    label = canonical_label(F.col("lang"))
    langs = F.col("language.langs")
    wrong = (F.size(langs) > 1) | label.isNull() | ~F.array_contains(langs, label)
    return read.where((F.size(langs) > 0) & wrong).select("doc_id", F.explode(langs).alias("lang"))
