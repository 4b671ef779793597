"""Markup: constructs, kept structure, main content, robustness."""

import random

import pytest
from pyspark.sql import functions as F

from loomdex.llm import markup

PLAIN = ["(x < 5, y > 2)", "a * b * c", "C:\\data\\new", "snake_case_name", "C#", "$40", "from $40 to $55", "R&D and Q&A", "f(x) = {1, 2}", "{n. d.}", "[sic]", "[3]", "|x| = 7", "<3 m", "#1", "10^6", "5*6=30 and 5*6=30", "~20 km",
         "4 << 6", "3 > 2", "• one\n• two", "说5*6=30，又5*6=30。", "", "  ", "A < B comparisons", "Works (1900–1910)", "#1. Today", "|x| = 7. He said"]
MARKED = ["<b>x</b>", "x <BR> y", "x <p y", "</div> x", "<!-- c -->", "a&nbsp;b", "&amp;quot;a&amp;quot;", "&lt;b&gt;x", "x &#x27;s", "# Head", "x **b** y", "x __b__ y", "x *b* y", "`c`", "```\ncode\n```", "[a](https://b.c)", "![a](b.png)", "a[^3] b",
          "~~a~~", "| a | b |\n|---|---|\n", "> quote", "- item", "Head\n-----", "[[a|b]]", "a]] b", "{{lang|xx|a}}", "{{Infobox a", "''a''", "== H ==", "{| class=\"w\"\n! a\n|-\n| b\n|}", "[https://a.b c]", "[[Category:A]]", "#REDIRECT [[x]]",
          "\\emph{a}", "\\\\textbf{a}", "x \\item y", "\\begin{verbatim}", "$x^2 + k_1$", "($k_{2}$)", "$$\na\n$$", "\\( a \\)", "50 \\%", "旅客__必须绕__道", "旅客*必须绕*道", "Zage*sag*ukal"]


@pytest.mark.parametrize("text", PLAIN)
def test_prose_has_no_construct(text):
    assert markup.clean(text) == (text, [])


@pytest.mark.parametrize("text", MARKED)
def test_constructs_are_found_and_gone(text):
    shown, found = markup.clean(text)
    assert found
    for mark in ("[[", "]]", "{{", "''", "&nbsp;", "&amp;", "</", "<!--", "\\emph", "\\textbf", "**", "__", "~~", "](", "<p"):
        assert mark not in shown


def test_the_jvm_filter_misses_nothing():
    import re

    suspect = re.compile(markup.SUSPECT.replace("(?m)", ""), re.M)
    assert all(suspect.search(t) for t in MARKED)


def test_structure_is_kept():
    html = "<html><head><title>T</title></head><body><div id=nav><ul><li><a href=x>Home</a></li><li><a href=y>About us</a></li></ul></div><div><h2>Head</h2><p>A long paragraph, with commas, that tells the reader something about the place it is on.</p><ul><li>one</li><li>two</li></ul><pre><code>a &lt; b\n  c</code></pre><p>\\(x^2\\) and <b>bold</b>, more text with commas, to weigh.</p><table><tr><td>k</td><td>v</td></tr></table></div></body></html>"
    shown, _ = markup.clean(html)
    assert shown == "## Head\n\nA long paragraph, with commas, that tells the reader something about the place it is on.\n\n- one\n- two\n\n```\na < b\n  c\n```\n\n$x^2$ and bold, more text with commas, to weigh.\n\n| k | v |"
    wiki, _ = markup.clean("{{Infobox p\n| a = 1\n}}\n'''A''' is [[b|c]].<ref>{{cite book|title=x}}</ref>\n\n== H ==\n* i\n* [[j]]\n\n:<math>e = 1</math>\n\n{| class=\"w\"\n| a || 1\n|-\n| b || 2\n|}\n[[Category:Q]]")
    assert wiki == "A is c.\n\n## H\n\n- i\n- j\n\n$$e = 1$$\n\n| a | 1 |\n| b | 2 |"
    tex, _ = markup.clean("\\documentclass{article}\n\\begin{document}\n\\section{H}\nA \\emph{b}\\footnote{p.~3} c~\\cite{k}.\n\\begin{itemize}\n\\item one\n\\item two\n\\end{itemize}\n\\begin{equation}\nE\n\\end{equation}\n\\begin{tabular}{ll}\na & 1 \\\\\nb & 2\n\\end{tabular}\n\\end{document}")
    assert tex == "## H\n\nA b c.\n\n- one\n- two\n\n$$E$$\n\n| a | 1 |\n| b | 2 |"
    md, _ = markup.clean("# T\n\nx **b** [l](http://a.b) ~~s~~[^1]\n\n1. a\n2. b\n\n```py\n# no heading\n```\n\nHead\n----\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n$$\ny\n$$")
    assert md == "# T\n\nx b l s\n\n1. a\n2. b\n\n```\n# no heading\n```\n\n## Head\n\n| a | b |\n| 1 | 2 |\n\n$$y$$"


def test_link_dense_boxes_go_and_text_beside_the_best_box_stays():
    para = "Some sentence, with commas, that is surely long enough to be counted as a paragraph of text."
    html = f"<div><p>Lead, also a sentence that is kept because it is not made of links.</p></div><div><p>{para}</p><p>{para}</p></div><div><a href=a>link one</a> <a href=b>link two</a> <a href=c>link three</a></div>"
    shown, _ = markup.clean(html)
    assert shown.startswith("Lead") and shown.count("Some sentence") == 2 and "link" not in shown.replace("made of links", "")


def test_entries():
    for raw, want in [("[[Category:A of B]]", "A of B"), (":Category:A of B|", "A of B"), ("A of B|Q*", "A of B"), ("''A of B''", "A of B"), ("{{lc:A of B}}", "a of b"), ("A&nbsp;of&nbsp;B", "A of B"), ("\\textit{A of B}", "A of B"), ("A of B<!-- check -->", "A of B"),
                      ("[A of B](/wiki/A_of_B)", "A of B"), ("A of B]]", "A of B"), ("{{A of B", "A of B"), ("A of B<br />", "A of B")]:
        shown, found = markup.clean_entry(raw)
        assert found and shown == want
    for raw in ("Songs & dances", "C# tools", "Works (1900–1910)", "Sites [former]", "R&D centres", "Prices under $5", "A < B comparisons"):
        assert markup.clean_entry(raw) == (raw, [])


def test_random_remains_never_fail():
    rng = random.Random(9)
    pieces = [*MARKED, *PLAIN, "\n", "\n\n", "<div>", "</div>", "<ul>", "<li>", "</p>", "<table><tr><td>", "{{", "}}", "[[", "<ref>", "</ref>", "```", "$$", "\\[", "<a href='x'>", "</a>", "\ue000", "\ue0035\ue002"]
    for _ in range(400):
        shown, _ = markup.clean("".join(rng.choices(pieces, k=rng.randrange(1, 30))))
        assert isinstance(shown, str)


def test_long_texts_take_time_in_proportion():
    import time

    for unit in ("[[a", "{{a", "<p ", "**a", "`a", "$a", "<div>", "\\emph{", "_a", "字*字", "&a", "[a](", "''", "| a ", "__a ", "<code>", "<!--", "[//a", "![", "\\(", "<ref>", "{{a|b", "<ul><li>a", "<math>", "a|b\n"):
        start = time.perf_counter()
        markup.clean(unit * 20_000)
        assert time.perf_counter() - start < 20, unit


def test_operator(spark):
    rows = [(1, "<b>x</b>", "keep"), (2, None, "k"), (3, "", "k"), (4, "plain", "k"), (4, "plain", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, constructs string")
    got = sorted((r.doc_id, r.clean_text, tuple(r.constructs)) for r in markup.clean_markup(df).collect() if r.doc_id != 2)
    assert got == [(1, "x", ("html_tag",)), (3, "", ()), (4, "plain", ()), (4, "plain", ())]
    null = markup.clean_markup(df).where("doc_id = 2").first()
    assert null.clean_text is None and null.constructs == []
    assert markup.clean_markup(df.limit(0)).count() == 0 and markup.clean_markup(df.withColumn("extra", F.lit(1))).columns == ["doc_id", "text", "constructs", "extra", "clean_text"]


@pytest.mark.parametrize("mark", ["<!--", "&lt;!--", "&amp;lt;!--"])
def test_a_comment_without_end_takes_no_text(mark):
    shown, found = markup.clean(f"One {mark} two.\n\nThree <!-- gone --> four, {mark} five.\n\nSix.")
    assert "html_comment" in found or "html_entity" in found
    assert "Six." in shown and "five" in shown and "<!--" not in shown
    shown, _ = markup.clean(f"One.\n\nThree <!-- gone --> four, {mark} five.\n\nSix.")
    assert shown == "One.\n\nThree four, five.\n\nSix."


PARA = "A long paragraph, with commas, that tells the reader something about the place, and goes on for a while."


@pytest.mark.parametrize("size", [881, 50_000])
def test_formulas_code_and_links_of_any_length(size):
    body = "x + " * (size // 4) + "1"
    assert markup.clean(f"Let ${body}$ be.") == (f"Let ${body}$ be.", ["latex_formula"])
    assert markup.clean(f"a *{body.replace('+', 'y')}* b")[1] == ["md_emphasis"]
    assert markup.clean(f"a __{body.replace('+', 'y')}__ b")[1] == ["md_strong"]
    assert markup.clean(f"[a](http://b.c/{'d' * size})")[0] == "a" and markup.clean(f"<b title='{'e' * size}'>f</b>")[0] == "f"


def test_boxes_of_any_depth():
    shown, found = markup.clean("<div>" * 3_000 + f"<p>{PARA}</p>" + "</div>" * 3_000)
    assert shown == PARA and found == ["html_tag"]


def test_constructs_are_those_of_the_nodes():
    root, _ = markup.parse(f"# T\n\n{PARA} **b**\n\n- [[x]]\n\n<div>{PARA} {{{{lang|fr|mot}}}}</div>\n\n\\section{{S}}\n\n$x^2$ &amp; y")
    made = {(n.kind, tuple(sorted(n.made_of))) for n in markup.walk(root) if n.made_of}
    assert ("heading", ("md_heading",)) in made and ("heading", ("latex_command",)) in made and ("item", ("md_list", "wiki_link")) in made
    assert any(kind == "para" and "wiki_template" in of for kind, of in made) and any("html_entity" in of and "latex_formula" in of for _, of in made)
    assert markup.origins(root) == sorted({o for n in markup.walk(root) for o in n.made_of})
    assert markup.origins(markup.parse(PARA)[0]) == []


def test_sections_lists_and_tables_of_all_syntaxes_are_containers():
    for text in (f"# A\n\n{PARA}\n\n## B\n\n- one\n- two\n\n| a | b |\n|---|---|\n| 1 | 2 |", f"== A ==\n{PARA}\n=== B ===\n* one\n* two\n{{|\n| a || b\n|-\n| 1 || 2\n|}}",
                 f"\\section{{A}}\n{PARA}\n\\subsection{{B}}\n\\begin{{itemize}}\n\\item one\n\\item two\n\\end{{itemize}}\n\\begin{{tabular}}{{ll}}\na & b \\\\\n1 & 2\n\\end{{tabular}}"):
        root, _ = markup.parse(text)
        outer = next(c for c in root.children if c.text == "part")
        inner = next(c for c in outer.children if c.text == "part")
        assert [c.text for c in outer.children[:1]] == ["A"] and [c.text for c in inner.children] == ["B", "list", "table"], text
        assert [n.text for n in inner.children[2].children] == ["a | b", "1 | 2"]


@pytest.mark.parametrize("menu", ["[Home](/)\n[About](/about)\n[News](/news)\n[Shop](/shop)\n[Log in](/login)", "- [Home](/)\n- [About](/about)\n- [News](/news)", "[Home](/)\n\n[About us](/about)\n\n[News](/news)", "<ul><li><a href='/'>Home</a></li><li><a href='/b'>News</a></li></ul>"])
def test_menus_of_any_syntax_go(menu):
    shown, _ = markup.clean(f"{menu}\n\n# T\n\n{PARA} See [the site](http://a.b).\n\n{PARA}")
    assert shown == f"# T\n\n{PARA} See the site.\n\n{PARA}"


def test_lists_of_wikitext_links_stay_and_emptied_parts_go():
    shown, _ = markup.clean(f"'''A''' {PARA}\n\n== See also ==\n* [[Foo]]\n* [[Bar baz]]\n\n== External links ==\n* [http://a.b site]\n* [http://c.d other site]")
    assert shown == f"A {PARA}\n\n## See also\n\n- Foo\n- Bar baz"


def test_templates_show_their_text():
    for raw, want in [("{{convert|10|km|mi}} of road", "10 km of road"), ("{{quote|He said this.|Bob}}", "He said this. Bob"), ("{{plainlist|\n* one\n* two\n}}", "- one\n- two"), ("{{lang|fr|mot}} {{nowrap|5 km}}", "mot 5 km"), ("x {{a|{{b|c}}|[[d|e]]}}", "x c e"),
                      ("x {{cite book|title=T|year=1}}{{Infobox a\n| b = c\n}}", "x"), ("{{uc:abc}} {{abbr|km|kilometre}}", "ABC km"), ("{{open|a", "open|a")]:
        assert markup.clean(raw)[0] == want


def test_ordered_lists_keep_their_numbers():
    for text in ("1. a\n2. b\n   1. c", "<ol><li>a</li><li>b<ol><li>c</li></ol></li></ol>", "\\begin{enumerate}\n\\item a\n\\item b\n\\begin{enumerate}\n\\item c\n\\end{enumerate}\n\\end{enumerate}"):
        assert markup.clean(text)[0] == "1. a\n2. b\n  1. c", text
    assert markup.clean("# a\n# b\n\n'''c'''")[0] == "1. a\n2. b\n\nc"
