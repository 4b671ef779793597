"""Wikitext fields, dumps, catalog and streams."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomdex.functions import wikitext
from loomdex.functions.text import abstract_slice, read_stop_words, snippet, strip_title_header
from loomdex.operators.orphans import OrphanLedger
from loomdex.sources import dumps
from loomdex.streaming import feeds

PAGE = """Discarded [[Early]] lead line
{{Infobox thing
| x = [[InBox]]
}}
'''Title''' is a [[Foo|foo]] thing.<ref>[[InRef]]</ref>
* joined to the previous [[Bar#sec|bar]]
== Heading ==
Later [[NotLead]] text
[[Category:Alpha beta|sort]]
[[Category:Gamma]]"""


def state_machine(text):
    """An independent reader that goes line by line."""
    lead, cats, keep, skipping, boxed, over = [], [], True, False, False, False
    for line in text.split("\n"):
        over = over or line.startswith("==")
        if line.startswith("[[Category"):
            parts = re.split(r":|\]\]|\|", line)
            cats.append(parts[1] if len(parts) > 1 else None)
            continue
        if "{{Infobox" in line and not boxed:
            lead, keep, skipping, boxed = [], False, True, True
        if skipping and line == "}}":
            keep, skipping = True, False
        if keep and line and not over:
            lead.append(line)
    if not lead:
        return [], 0, cats
    paras, begun = [""], False
    for line in lead:
        begun = begun or line[0].isalpha() or line.startswith("'''")
        if not begun or re.fullmatch(r"<!--.*?-->", line) or re.fullmatch(r"\{\{.*?\}\}", line):
            continue
        if re.match(r"[a-zA-Z{\[(]", line):
            paras.append(line)
        else:
            paras[-1] += line
    found = [x for p in paras for x in re.findall(r"\[\[.*?\]\]?", re.sub(r"<ref.*?</ref>", "", p))]
    return [re.sub(r"\[\[|\]\]", "", x).split("|")[0].split("#")[0] for x in found], len(paras), cats


def parsed(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [(r.links, r.abstract_end, r.categories) for r in wikitext.parse(df, "text", **kw).orderBy("i").collect()]


def test_page_fixture(spark):
    assert parsed(spark, [PAGE]) == [(["Foo", "Bar"], 1, ["Alpha beta", "Gamma"])]


def test_random_pages_match_a_state_machine(spark):
    rng = random.Random(3)
    pool = ["{{Infobox a", "}}", "== H ==", "[[Category:X y|k]]", "[[Category", "'''B''' [[Q|q]]", "Text [[A#b]] more", "* item [[C]]", "[[D]] opens", "(e) [[F", "<!-- c -->", "{{t}}", "", "Über [[G]]", "中文[[H]]", "<ref>[[no]]</ref> x", "]] rest", "1 digit"]
    texts = ["\n".join(rng.choices(pool, k=rng.randrange(0, 12))) for _ in range(300)]
    assert parsed(spark, texts) == [state_machine(t) for t in texts]


def test_redirect_pages_and_nulls(spark):
    df = spark.createDataFrame([(PAGE, "To"), (None, ""), ("", None)], "text string, redirect string")
    assert [(r.links, r.abstract_end, r.categories) for r in wikitext.parse(df, "text", F.col("redirect")).collect()] == [([], 0, [])] * 3


def test_plain_text(spark):
    row = spark.createDataFrame([("'''A''' is [[b|c]] ( ) <ref name=x>r</ref>and {{t|u}}<b>d</b>.",)], "t string")
    assert row.select(wikitext.plain_text(F.col("t"))).first()[0] == "A is c and d."


def test_slices(spark):
    df = spark.createDataFrame([("T\n\na\nb\nc\nd", 1), ("T\n\na\nb\nc\nd", 0), ("T\na", 5), (None, 1), ("", None)], "t string, e int")
    got = [r[0] for r in df.select(abstract_slice(F.col("t"), F.col("e"))).collect()]
    assert got == [["a"], ["a", "b", "c"], ["a"], None, []]
    one = spark.createDataFrame([("Alpha\n\nbody\n\nmore",), ("no header",)], "t string")
    assert [r[0] for r in one.select(strip_title_header(F.col("t"))).collect()] == ["body\n\nmore", "no header"]
    assert one.select(snippet(F.col("t"), 3)).first()[0] == "Alp"


def test_xml_dump(spark, tmp_path):
    pages = spark.createDataFrame([(1, "A & <b>", "", "[[B]] x\n[[Category:Q]]"), (2, "Help:x", "", "t"), (3, "R", "A & <b>", "#"), (4, "None", "", None)], "id long, title string, redirect string, text string")
    dumps.write_xml_dump(pages, str(tmp_path / "d"))
    read = dumps.read_xml_dump(spark, str(tmp_path / "d"))
    assert {r.id: (r.title, r.redirect) for r in read.collect()} == {1: ("A & <b>", ""), 2: ("Help:x", ""), 3: ("R", "A & <b>")}
    assert sorted((r.id, r.links, r.categories) for r in dumps.page_fields(read).collect()) == [(1, [], ["Q"]), (3, [], [])]
    assert [r.id for r in dumps.page_fields(read.withColumn("redirect", F.when(F.col("id") == 1, F.col("title")).otherwise("")), "zh", {"&": "&"}).orderBy("id").collect()] == [2, 3]


def test_lines_stop_words_and_chunks(spark, tmp_path):
    (tmp_path / "wiki_00").write_text('{"id": "1", "url": "u", "title": "t", "text": "x"}\n{"id": 2}\n')
    (tmp_path / "other").write_text('{"id": 9}\n')
    assert sorted((r.id, r.text) for r in dumps.read_texts(spark, str(tmp_path), "wiki*").collect()) == [(1, "x"), (2, None)]
    (tmp_path / "stop").write_bytes(b"the\r\n of \r\n\r\nof")
    assert read_stop_words(spark, str(tmp_path / "stop")) == ["of", "the"]
    dumps.write_chunks(spark.range(10).coalesce(1), str(tmp_path / "c"), 4)
    assert len(list((tmp_path / "c").glob("*.parquet"))) == 3


def test_catalog(spark, tmp_path):
    catalog = dumps.Catalog(spark, str(tmp_path))
    made = []
    compute = lambda: made.append(1) or spark.createDataFrame([("b", 1), ("a", 2)], "term string, df long")
    assert catalog.load_or_compute("terms", compute).count() == 2 and catalog.load_or_compute("terms", compute).count() == 2 and made == [1]
    fetched = catalog.fetch("terms", ["a"])
    assert fetched.first().df == 2 and "(term,a)]" in fetched._jdf.queryExecution().executedPlan().toString().partition("PushedFilters")[2]
    assert catalog.zone_map("terms").agg(F.min("first"), F.max("last")).first() == ("a", "b")


def test_title_shards(spark):
    df = spark.createDataFrame([("apple",), ("Äpfel",), ("x" * 21,)], "t string")
    assert [tuple(r) for r in df.select(dumps.title_shard(F.col("t")), dumps.title_shard(F.col("t"), "zh")).collect()] == [("A", "5"), ("other", "5"), ("X", "other")]


def test_stream_of_postings_is_safe_to_restart(spark, tmp_path):
    docs, out = tmp_path / "in", str(tmp_path / "out")
    send = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").write.mode("append").parquet(str(docs))
    run = lambda checkpoint: feeds.append_postings(spark.readStream.schema("doc_id long, text string").parquet(str(docs)), out, str(tmp_path / checkpoint)).awaitTermination(120)
    held = lambda: {(r.term, r.doc_id, tuple(r.lc)) for r in feeds.read_postings(spark, out).collect()}
    send([(1, "red ring red"), (2, None), (3, "gear")])
    run("cp")
    assert held() == {("red", 1, (0, 2)), ("ring", 1, (1,)), ("gear", 3, (0,))}
    send([(1, "blue ring"), (3, "12")])  # both sent again, one without any token
    run("cp")
    assert held() == {("blue", 1, (0,)), ("ring", 1, (1,))}
    run("lost")  # a lost checkpoint: all is sent again as batch 0
    assert {h[:2] for h in held()} >= {("blue", 1), ("ring", 1)}


def test_stream_of_the_ledger_survives_a_restart(spark, tmp_path):
    schema = "kind string, field string, src_id long, space string, key string, at long, begins long, ends long"
    events, state = tmp_path / "events", str(tmp_path / "state")
    send = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(events))
    run = lambda cp: feeds.advance_ledger(spark.readStream.schema(schema).parquet(str(events)), state, str(tmp_path / cp)).awaitTermination(120)
    shown = lambda: {(r.key, r.reason, r.open) for r in OrphanLedger.load(spark, state)[0].report().collect()}
    assert OrphanLedger.load(spark, state)[1] == -1
    send([("reference", "a", 1, "t", "k", 5, None, None), ("reference", "a", 2, "t", "q", 5, None, None)])
    run("cp")
    assert shown() == {("k", "missing", True), ("q", "missing", True)}
    send([("span", None, None, "t", "k", None, 9, None)])
    run("cp")  # a new query object: nothing is left in the driver's memory
    assert shown() == {("k", "late", False), ("q", "missing", True)} and OrphanLedger.load(spark, state)[1] == 1
    run("lost")  # the stream begins anew: stored batches are not taken in again
    ledger, last = OrphanLedger.load(spark, state)
    assert shown() == {("k", "late", False), ("q", "missing", True)} and last == 1
    assert {(r.as_of, r.reason, r.open, r.n) for r in ledger.snapshots.collect()} == {(5, "waiting", True, 2), (9, "late", False, 1), (9, "waiting", True, 1)}


@pytest.mark.parametrize("column", ["title", "redirect"])
def test_namespaces_accept_nulls(spark, column):
    df = spark.createDataFrame([(None, "x")], "title string, redirect string")
    assert df.where(wikitext.no_self_redirect(F.col("title"), F.col("redirect"))).count() == 1
