"""Tokenizer round trips and language identification."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomdex.llm import bpe, langid

# ---------------------------------------------------------------- problem 8


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.model_bytes())


@pytest.fixture(scope="module")
def peer():
    import tiktoken

    tokens = bpe.read_ranks(os.path.join(bpe.TOKENIZER_DIR, "byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("peer", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text_round_trips_and_equals_the_rank_merges(encoder, peer, text):
    ids = encoder.encode(text)
    assert encoder.decode(ids) == text and ids == peer.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", " ", "\n\n  x", "<|endoftext|>", "don't I'LL", "▁▁ a", "\x00\x01", "한국어 中文 العربية", "👩‍🔬" * 5, "a" * 5000, "中" * 3000, " " * 2000 + "x", "‫שלום‬", "<unk><s></s>"])
def test_odd_texts(encoder, peer, text):
    ids = encoder.encode(text)
    assert encoder.decode(ids) == text and ids == peer.encode_ordinary(text)


def test_both_vocabularies(peer):
    other = bpe.Encoder(bpe.model_bytes("byte_bpe_multi_50k"))
    assert other.decode(other.encode("Größe 中文 été")) == "Größe 中文 été"


def test_operator_defines_null_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "", "x"), (3, None, "x"), (1, "a b", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode(df).collect())
    assert got == [(1, [64, 275]), (1, [64, 275]), (2, []), (3, [])]
    assert bpe.encode(df, null_ids="null").where("doc_id = 3").first().ids is None
    assert bpe.encode(df.limit(0)).count() == 0 and bpe.encode(df).columns == ["doc_id", "text", "ids"]
    assert bpe.round_trip_failures(df).count() == 0
    assert [r.n for r in df.select("doc_id", bpe.count_column(df, F.col("text")).alias("n")).orderBy("doc_id").collect()] == [2, 2, 0, None]
    with pytest.raises(ValueError):
        bpe.encode(df, null_ids="zero")


# ---------------------------------------------------------------- problem 10

TEXTS = {
    "en": ["The old bridge was rebuilt after the flood", "Most visitors come in summer for the market", "Nobody knows who paid for the tower", "It was written by a teacher of the village", "The harbour lies below the church"],
    "de": ["Die alte Brücke wurde nach der Flut wieder aufgebaut", "Die meisten Besucher kommen im Sommer zum Markt", "Niemand weiß wer den Turm bezahlt hat", "Es wurde von einem Lehrer des Dorfes geschrieben", "Der Hafen liegt unter der Kirche"],
    "fr": ["Le vieux pont fut reconstruit après la crue", "La plupart des visiteurs viennent en été pour le marché", "Personne ne sait qui a payé la tour", "Il fut écrit par un maître du village", "Le port se trouve sous l'église"],
    "es": ["El viejo puente fue reconstruido después de la crecida", "La mayoría de los visitantes vienen en verano al mercado", "Nadie sabe quién pagó la torre", "Fue escrito por un maestro del pueblo", "El puerto está debajo de la iglesia"],
    "zh": ["旧桥在洪水之后重新修建了", "大多数游客夏天来这里的集市", "没有人知道是谁出资修建了塔楼", "这是村里的一位教师写的", "港口位于教堂的下面"],
}


def corpus(seed, n=60):
    rng = random.Random(seed)
    out = {}
    for lang, ss in TEXTS.items():
        stop = "。" if lang == "zh" else ". "
        out[lang] = [stop.join(rng.choices(ss, k=4)) + stop.strip() for _ in range(n)]
    return out


@pytest.fixture(scope="module")
def identifier():
    noisy = corpus(1)
    rng = random.Random(2)
    for lang in list(noisy):  # a tenth of the labels is wrong
        for _ in range(6):
            noisy[rng.choice([x for x in noisy if x != lang])].append(noisy[lang].pop())
    return langid.fit(noisy)


def test_probabilities_of_a_context_sum_to_one():
    from collections import Counter

    model = langid.KneserNey(Counter({"abc": 5, "abd": 3, "bcd": 2, "a": 1}), alphabet=7)
    # every continuation of "ab" over the model's alphabet of 7 signs (letters, the end, the rest)
    signs = ["a", "b", "c", "d", "x", "y"]

    def chance(word, end=True):
        owner, place, grams, contexts = langid._grams([word], langid.ORDER)
        p = np.full(len(owner), model.floor)
        for n in range(1, model.order + 1):
            p = model._step(n, grams[n - 1], contexts[n - 1], p)
        return p

    total = sum(chance("ab" + s)[2] for s in signs) + chance("ab")[2]
    assert total == pytest.approx(1, abs=1e-9)


def test_held_out_sentences(identifier):
    held = corpus(5)
    texts = [(lang, t) for lang, ts in held.items() for t in ts]
    read = langid.read_texts(identifier, [t for _, t in texts])
    assert all(langs == [lang] for (lang, _), (langs, _, _) in zip(texts, read))
    assert np.mean([s["confidence"] for _, _, ss in read for s in ss]) > 0.9


def test_mixed_texts_and_segments(identifier):
    en, zh, fr = (". ".join(TEXTS["en"][:3]) + ". "), "。".join(TEXTS["zh"][:2]) + "。", "".join(TEXTS["fr"][:1]) + ". "
    text = en + "\n\n" + zh
    langs, shares, segments = langid.read_texts(identifier, [text])[0]
    assert langs == ["en", "zh"] and shares == [0.6, 0.4]
    assert [(s["lang"], text[s["start"] : s["end"]].strip()) for s in segments] == [("en", en.strip()), ("zh", zh)]
    # one quoted sentence among nine is below a fifth
    long = en * 2 + fr + ". ".join(TEXTS["en"][:2]) + "."
    langs, shares, segments = langid.read_texts(identifier, [long])[0]
    assert langs == ["en"] and [s["lang"] for s in segments] == ["en", "fr", "en"]


def test_texts_without_language(identifier):
    read = langid.read_texts(identifier, [None, "", "  \n", "12 + 3 = 15.", "10^6. #1."])
    assert all(r == ([], [], []) for r in read)
    assert langid.read_texts(identifier, ["Le pont"])[0][0] == ["fr"]
    assert langid.read_texts(identifier, [TEXTS["de"][0].upper() + ". " + TEXTS["de"][1].upper() + "."])[0][0] == ["de"]


def test_very_long_text(identifier):
    text = "The old bridge was rebuilt. " * 5000 + "字" * 50_000 + "x" * 100_000
    assert langid.read_texts(identifier, [text])[0][0] == ["en"]


def test_labels(spark):
    rows = ["en", " EN", "en-GB", "en_US", "English", "eng", "中文", "zh-CN", "zho", "Español", "fre", "ger", "de-AT", "nl", "xx", "und", "", " ", None, "??", "n/a"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "x string").select(langid.canonical_label(F.col("x"))).collect()]
    assert got == ["en"] * 6 + ["zh"] * 3 + ["es", "fr", "de", "de"] + [None] * 8


def test_relabel(spark, identifier):
    say = lambda lang: ". ".join(TEXTS[lang][:4]) + "."
    rows = [(1, say("en"), "en-GB"), (2, say("en"), "de"), (3, say("fr"), None), (4, say("de") + "\n" + say("es"), "de"), (5, "12", None), (6, None, None), (7, say("zh"), "nl"), (8, "", "en"), (1, say("en"), "en-GB")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("language", F.lit("clash")).withColumn("start", F.lit(1))
    assert sorted(map(tuple, langid.relabel(df, identifier=identifier).collect())) == [(2, "en"), (3, "fr"), (4, "de"), (4, "es"), (7, "zh")]
    assert langid.relabel(df.limit(0)).count() == 0
    assert {k: len(v) for k, v in langid.sample_texts(df, 1).items()} == {"de": 1, "en": 1, "es": 0, "fr": 0, "zh": 0}


FOREIGN = {
    "it": ["Il vecchio ponte di pietra è stato ricostruito dopo l'alluvione del secolo scorso.", "Nessuno sa chi abbia pagato la torre rotonda, ma il consiglio del villaggio la possiede ancora."],
    "ru": ["Старый каменный мост был восстановлен после наводнения.", "Большинство посетителей приезжает летом на рынок."],
    "nl": ["De oude stenen brug werd na de overstroming herbouwd en de meeste bezoekers komen in de zomer."],
    "code": ["def toll(weight, distance):\n    return weight * distance // 86", "for i in range(10): print(i); x = [j for j in y if j > 3]"],
    "noise": ["qzx wvk jjq", "asdkfj aslkdjf qwoieu zxmcnb qpwoe."],
}


@pytest.fixture(scope="module")
def on_documents():
    """Models fitted on the test documents, as the queries do."""
    import pandas as pd

    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    names = {name: code for code, spelled in langid.SPELLINGS.items() for name in spelled}
    out = {lang: [] for lang in langid.LANGUAGES}
    for text, label in zip(docs.text, docs.lang):
        code = names.get((label or "").strip().lower())
        if code and text:
            out[code].append(text)
    return langid.fit(out)


@pytest.mark.parametrize("kind", sorted(FOREIGN))
def test_what_is_in_none_of_the_languages_is_rejected(on_documents, kind):
    for text in [*FOREIGN[kind], " ".join(FOREIGN[kind])]:
        langs, shares, segments = langid.read_texts(on_documents, [text])[0]
        assert langs == [] and shares == [] and {(s["lang"], s["confidence"]) for s in segments} == {("und", 0.0)}


def test_mixed_with_a_foreign_language(on_documents):
    english = "The old stone bridge was built by stone masons in 1745. The climate is mild and the wettest month brings rain. "
    text = english + FOREIGN["it"][0] + "\n" + FOREIGN["it"][1]
    langs, shares, segments = langid.read_texts(on_documents, [text])[0]
    assert langs == ["en"] and shares == [0.5] and [s["lang"] for s in segments] == ["en", "und"]
    # one English sentence among six is below a fifth: the text has no language of ours
    assert langid.read_texts(on_documents, ["\n".join(FOREIGN["it"] * 3) + "\n" + english.split(". ")[0] + "."])[0][0] == []


def test_confidence_is_calibrated_on_held_out_sentences(on_documents):
    c = on_documents.calibration
    assert c["sentences"] > 100 and c["accuracy"] > 0.99 and c["calibration_error"] < 0.02 and c["rejected"] < 0.02


def test_stray_signs_do_not_reject_a_sentence(on_documents):
    text = "The climate is mild, and the wettest month brings aroun‫שלום‬d 82 millimetres of rain."
    assert langid.read_texts(on_documents, [text])[0][0] == ["en"]
