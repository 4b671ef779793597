"""Problem 1: markup residue in text documents.

:func:`clean` turns one text that carries HTML, Markdown, wikitext or LaTeX, whole or in remains,
into clean text with headings (``# x``), lists (``- x``, ``1. x``), tables (``| x |``), code blocks
(fenced) and formulas (``$x$``, ``$$x$$``), and names the constructs it found.

Method: all four syntaxes become one tree. Its containers are HTML boxes, sections (from headings
of any syntax), lists, tables and quotes; its leaves are paragraphs, headings, items, rows, code
and formulas. Paragraphs pass points for length and commas to their ancestors, containers are
discounted by link density, and the best container is kept together with those siblings that carry
text. Every node keeps the markup it was made from, so the constructs of a text are those of its
nodes; a text whose tree has none comes back unchanged.

Whole texts of any length are read, by patterns that look ahead no further than to the next mark of
their kind; code, formulas, tags and nesting have no greatest size.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from html.entities import html5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML and of wikitext extensions.
BLOCKS = "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form gallery h1 h2 h3 h4 h5 h6 header hr html li main nav ol p section summary table tbody td tfoot th thead tr ul".split()
INLINE = "a abbr b bdi bdo big br cite code col colgroup del dfn em font head i iframe img includeonly input ins kbd label link map mark math meta mfrac mi mn mo mrow msqrt msub msup mtext noinclude nowiki object onlyinclude option poem pre q ref references s samp script select small source span strike strong style sub sup svg syntaxhighlight templatestyles textarea time title tt u var video wbr".split()
NAMES = "|".join(sorted(BLOCKS + INLINE, key=len, reverse=True))
# LaTeX commands that occur without an argument, and the signs that some stand for.
BARE = "alpha|beta|gamma|delta|lambda|mu|pi|sigma|omega|item|maketitle|tableofcontents|frac|sum|prod|int|leq|geq|neq|approx|infty|sqrt|ldots|dots|cdot|times|quad|qquad|hline|toprule|midrule|bottomrule|centering|noindent|newline|newpage|par|tiny|small|large|textit|textbf|emph|cite|ref|section|subsection"
SIGNS = {"alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "lambda": "λ", "mu": "μ", "pi": "π", "sigma": "σ", "omega": "ω", "sum": "∑", "prod": "∏", "int": "∫", "leq": "≤", "geq": "≥", "neq": "≠", "approx": "≈", "infty": "∞", "sqrt": "√", "ldots": "…", "dots": "…", "cdot": "·", "times": "×", "quad": " ", "qquad": " "}
# LaTeX commands whose argument is not part of the running text.
UNSHOWN = set("footnote cite citep citet ref label eqref pageref index includegraphics usepackage documentclass bibliography bibliographystyle vspace hspace input begin end".split())
# Namespace words of categories and files in the languages of the texts.
NAMESPACES = "Category|Kategorie|Catégorie|Categoría|分类|分類|File|Image|Datei|Fichier|Archivo|文件"
# Beginnings of the names of templates that show no text of their own page.
SILENT = ("infobox", "cite", "citation", "reflist", "refn", "efn", "sfn", "navbox", "authority control", "main", "see also", "further", "portal", "commons", "short description", "use dmy", "use mdy", "defaultsort")

# ---------------------------------------------------------------- provenance

ORIGINS = ("html_tag", "html_broken_tag", "html_comment", "html_entity", "md_heading", "md_fence", "md_code", "md_strong", "md_emphasis", "md_link", "md_footnote", "md_strike", "md_table", "md_quote", "md_list", "md_rule",
           "wiki_link", "wiki_template", "wiki_quote", "wiki_heading", "wiki_table", "wiki_list", "wiki_namespace", "wiki_magic", "wiki_redirect", "wiki_external", "wiki_sort_key", "latex_command", "latex_environment", "latex_formula", "latex_escape")
#: What is consumed before the tree stands leaves one sign of its origin in the text, which the
#: node that is made of that place takes up.
_SIGN = {name: chr(0xE100 + i) for i, name in enumerate(ORIGINS)}
_ORIGIN_OF = {sign: name for name, sign in _SIGN.items()}
_SIGNS = re.compile("[\ue100-\ue1ff]")
_HOLD = re.compile("\ue000(\\d+)\ue001")
_PRIVATE = re.compile("[\ue000-\ue004\ue100-\ue1ff]")


class Node:
    """A container (``kind`` 'box', ``text`` its name) or a leaf: para, heading, item, row, code.
    ``made_of`` names the markup it came from."""

    __slots__ = ("kind", "level", "text", "link", "links", "number", "children", "made_of", "score", "size", "gone")

    def __init__(self, kind: str, text: str = "", level: int = 0, link: float = 0, links: int = 0, number: int = 0, made_of: set[str] | None = None):
        self.kind, self.text, self.level, self.link, self.links, self.number = kind, text, level, link, links, number
        self.children: list[Node] = []
        self.made_of: set[str] = made_of if made_of is not None else set()
        self.score, self.size, self.gone = 0.0, len(text) if kind != "box" else 0, False


def walk(root: Node) -> list[Node]:
    """All nodes in the order of the text; parents stand before their children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out


def origins(root: Node) -> list[str]:
    """Names of the constructs that the nodes of a tree were made from, sorted."""
    found: set[str] = set()
    for node in walk(root):
        found |= node.made_of
    return sorted(found)


# ---------------------------------------------------------------- code and formulas

_S = re.S | re.I
_ANY_TAG = re.compile(rf"(?i)</?(?:{NAMES})(?=[\s/>])[^<>]*>|</[A-Za-z][A-Za-z0-9]*\s*>")
#: (what must occur, pattern, kind, origin, whether tags inside are HTML); an open one ends with the text.
_CODE = [
    ("<", re.compile(r"<syntaxhighlight\b[^<>]*>(.*?)(?:</syntaxhighlight\s*>|\Z)", _S), "code", "html_tag", False),
    ("<", re.compile(r"<source\s+lang[^<>]*>(.*?)(?:</source\s*>|\Z)", _S), "code", "html_tag", False),
    ("<", re.compile(r"<pre\b[^<>]*>(.*?)(?:</pre\s*>|\Z)", _S), "code", "html_tag", True),
    ("\\begin", re.compile(r"\\begin\{(?:verbatim|lstlisting)\}(.*?)(?:\\end\{(?:verbatim|lstlisting)\}|\Z)", _S), "code", "latex_environment", False),
    ("```", re.compile(r"(?m)^```[^\n`]*\n(.*?)(?:^```[ \t]*$|\Z)", re.S), "code", "md_fence", False),
]
#: As above, with the mark that must still follow.
_SPANS = [
    ("<", re.compile(r"<(?:code|tt|samp|kbd)\b[^<>]*>(.*?)</(?:code|tt|samp|kbd)\s*>", _S), "tick", "html_tag", True, re.compile(r"</(?:code|tt|samp|kbd)\s*>", re.I)),
    ("`", re.compile(r"(?<!`)`{1,2}([^`\n]+)`{1,2}(?!`)"), "tick", "md_code", False, None),
    ("$$", re.compile(r"\$\$(.+?)\$\$", re.S), "display", "latex_formula", False, None),
    ("\\[", re.compile(r"\\\[(.+?)\\\]", re.S), "display", "latex_formula", False, re.compile(r"\\\]")),
    ("\\begin", re.compile(r"\\begin\{(?:equation|align|displaymath|gather)\*?\}(.*?)(?:\\end\{(?:equation|align|displaymath|gather)\*?\}|\Z)", _S), "display", "latex_environment", False, None),
    ("<math", re.compile(r"(?m)^:<math\b[^<>]*>(.*?)</math\s*>", _S), "display", "html_tag", True, re.compile(r"</math\s*>", re.I)),
    ("<math", re.compile(r"<math\b[^<>]*>(.*?)</math\s*>", _S), "math", "html_tag", True, re.compile(r"</math\s*>", re.I)),
    ("\\(", re.compile(r"\\\((.+?)\\\)", re.S), "math", "latex_formula", False, re.compile(r"\\\)")),
]


def _until(pattern: re.Pattern, close: re.Pattern | None, by, text: str) -> str:
    """Replace, reading no further than the last closing mark."""
    if close is None:
        return pattern.sub(by, text)
    end = max((m.end() for m in close.finditer(text)), default=0)
    return pattern.sub(by, text[:end]) + text[end:] if end else text


_FORMULA_SIGN = re.compile(r"[\\^_={}+<>]")


def _dollar_spans(text: str) -> Iterator[tuple[int, int]]:
    """Places of ``$x$`` on one line: one or two letters or something with a sign of formulas,
    no blank inside the dollars, no digit behind (so that prices are none)."""
    at = text.find("$")
    while at >= 0:
        end = text.find("$", at + 1)
        if end < 0:
            return
        body = text[at + 1 : end]
        fits = body and "\n" not in body and not body[0].isspace() and not body[-1].isspace() and not text[end + 1 : end + 2].isdigit()
        if fits and (_FORMULA_SIGN.search(body) or (len(body) <= 2 and body.isascii() and body.isalpha())):
            yield at, end + 1
            at = text.find("$", end + 1)
        else:
            at = end


class _Holder:
    """Code and formulas, set aside so that no other rule reads them."""

    def __init__(self) -> None:
        self.kept: list[tuple[str, str, str]] = []

    def put(self, kind: str, body: str, origin: str) -> str:
        body = body.strip("\n") if kind == "code" else body.strip()
        if not body.strip():
            return _SIGN[origin] + " "
        self.kept.append((kind, body, origin))
        mark = f"\ue000{len(self.kept) - 1}\ue001"
        return f"\n\n{mark}\n\n" if kind in ("code", "display") else mark

    def show(self, text: str) -> str:
        def one(m: re.Match) -> str:
            kind, body, _ = self.kept[int(m[1])]
            return {"code": f"```\n{body}\n```", "tick": body, "display": f"$${body}$$", "math": f"${body}$"}[kind]

        return _HOLD.sub(one, text) if "\ue000" in text else text

    def origins(self, text: str) -> set[str]:
        return {self.kept[int(n)][2] for n in _HOLD.findall(text)} if "\ue000" in text else set()

    def hold(self, text: str) -> str:
        def put(kind: str, origin: str, tags: bool):
            return lambda m: self.put(kind, html.unescape(_ANY_TAG.sub("", m[1])) if tags else m[1], origin)

        for need, pattern, kind, origin, tags in _CODE:
            if need in text:
                text = pattern.sub(put(kind, origin, tags), text)
        for need, pattern, kind, origin, tags, close in _SPANS:
            if need in text:
                text = _until(pattern, close, put(kind, origin, tags), text)
        if "$" in text:
            parts, at = [], 0
            for a, b in _dollar_spans(text):
                parts += [text[at:a], self.put("math", text[a + 1 : b - 1], "latex_formula")]
                at = b
            text = "".join(parts) + text[at:]
        return text


# ---------------------------------------------------------------- before the tree

_ENTITY = re.compile(r"&(?:#(\d+)|#[xX]([0-9a-fA-F]+)|([A-Za-z][A-Za-z0-9]+));|(?i:&(nbsp|quot|amp|lt|gt)(?![a-z;=]))")


def _unescape(text: str) -> str:
    """Entities by their characters; the first leaves its sign."""
    sign = _SIGN["html_entity"]

    def one(m: re.Match) -> str:
        nonlocal sign
        if m[3] and m[3] + ";" not in html5 and m[3].lower() + ";" not in html5:
            return m[0]
        shown = html.unescape(m[0] if not m[3] or m[3] + ";" in html5 else m[0].lower()) if not m[4] else html.unescape(f"&{m[4].lower()};")
        shown, sign = sign + shown, ""
        return shown

    for _ in range(2):  # entities may be escaped twice
        if "&" not in text:
            break
        text = _ENTITY.sub(one, text)
    return text


# a comment that is never closed loses only its mark, by a rule for remains
_COMMENT, _COMMENT_END = re.compile(r"<!--.*?-->", re.S), re.compile("-->")
_UNSEEN = [(re.compile(r"<(head|style|script)\b[^<>]*>.*?</\1\s*>", _S), re.compile(r"</(?:head|style|script)\s*>", re.I)), (re.compile(r"<ref\b[^<>]*/>", re.I), None), (re.compile(r"<ref\b[^<>]*>.*?</ref\s*>", _S), re.compile(r"</ref\s*>", re.I))]


def _no_unseen(text: str, by: str, rules: list) -> str:
    if "<!--" in text:
        text = _until(_COMMENT, _COMMENT_END, _SIGN["html_comment"] + by, text)
    for pattern, close in rules:
        if "<" in text:
            text = _until(pattern, close, _SIGN["html_tag"] + by, text)
    return text


_TABULAR = re.compile(r"\\begin\{(tabular|array)\}(?:\{[^{}\n]*\})?(.*?)(?:\\end\{\1\}|\Z)", re.S)


def _tabular(m: re.Match) -> str:
    rows = [row.replace("\\hline", "").strip() for row in m[2].split("\\\\")]
    return _SIGN["latex_environment"] + "\n\n" + "\n".join("| " + " | ".join(c.strip() for c in row.split("&")) + " |" for row in rows if row) + "\n\n"


_BRACES = re.compile(r"\{\{|\}\}")
_NAMED = re.compile(r"\s*[^\s=\[<][^=\[\]<\n]*=")
_NUMBERED = re.compile(r"\s*\d+\s*=")
_PLAIN_LINK = re.compile(r"\[\[[^\[\]]*\]\]")


def _template(body: str) -> str:
    """A template gives way to the text it shows: its arguments without a name, of a few known
    ones those that are running text; named ones (boxes, citations) are data about the page."""
    name, *args = [a.replace("\ue004", "|") for a in _PLAIN_LINK.sub(lambda m: m[0].replace("|", "\ue004"), body).split("|")]
    name = name.strip()
    low = name.lower()
    if low.startswith(SILENT):
        return " "
    if not args:
        word, colon, rest = name.partition(":")
        return {"lc": rest.lower(), "uc": rest.upper(), "ucfirst": rest[:1].upper() + rest[1:]}.get(word.lower(), rest) if colon else " "
    plain = [_NUMBERED.sub("", a).strip() for a in args if _NUMBERED.match(a) or not _NAMED.match(a)]
    plain = [a for a in plain if a]
    if low in ("plainlist", "flatlist", "ubl", "unbulleted list", "hlist", "bulleted list"):
        return "\n\n" + "\n".join(a if a.startswith("*") else "* " + a for a in plain) + "\n\n"
    if low.startswith(("lang", "transl")):
        plain = plain[-1:]
    elif low in ("convert", "cvt"):
        plain = plain[:2]
    elif low in ("abbr", "tooltip", "w"):
        plain = plain[:1]
    return " ".join(plain) or " "


def _templates(text: str) -> str:
    """Templates from the inside out, in one pass over their braces."""
    stack: list[list[str]] = [[]]
    at = 0
    for m in _BRACES.finditer(text):
        stack[-1].append(text[at : m.start()])
        at = m.end()
        if m[0] == "{{":
            stack.append([])
        elif len(stack) > 1:
            stack[-2].append(_SIGN["wiki_template"] + _template("".join(stack.pop())))
        else:
            stack[-1].append("}}")
    stack[-1].append(text[at:])
    return "{{".join("".join(parts) for parts in stack)


# ---------------------------------------------------------------- running text

_HAN = "[㐀-鿿]"
#: A pair of marks of which one has a Chinese character beside it.
_BY_HAN = rf"(?:(?<={_HAN}){{m}}(?=[^\s*_])|(?<![\w*]){{m}}(?={_HAN})|(?<=\w){{m}}(?={_HAN}))[^*_\n]+(?<=[^\s*_]){{m}}(?![*_])|(?<!\*){{m}}(?=[^\s*_])[^*_\n]+(?:(?<={_HAN}){{m}}|(?<=[^\s*_]){{m}}(?={_HAN}))"
_URL = r"((?:[^()\s]|\([^()\s]*\))*)"
_TITLE = r"(?:\s+\"[^\"\n]*\")?"
_IN_URL = re.compile(r"[:/#.]")
_ATTRIBUTES = r"(?:\s+[\w:-]+\s*=\s*(?:\"[^\"<>\n]*\"|'[^'<>\n]*'|[^\s<>]+))*"

# linked text stands between \ue003 (or \ue002 for wikitext's own links) and \ue004 until its length is known
def _md_link(m: re.Match) -> str:
    return f"\ue003{m[1]}\ue004" if _IN_URL.search(m[2]) else m[0]


def _md_open_link(m: re.Match) -> str:
    return "" if _IN_URL.search(m[1]) else m[0]


#: (what must occur, pattern, replacement, origin), in order.
_INLINE = [
    ("[[", re.compile(rf"\[\[:?(?:{NAMESPACES}):[^\[\]\n]*\]\]", re.I), "", "wiki_link"),
    ("[[", re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]"), "\ue002\\1\ue004", "wiki_link"),
    ("![", re.compile(rf"!\[([^\[\]\n]*)\]\({_URL}{_TITLE}\)"), "\\1", "md_link"),
    ("![", re.compile(r"!\[([^\[\]\n]*)\]\("), "\\1", "md_link"),
    ("](", re.compile(rf"\[([^\[\]\n]*)\]\({_URL}{_TITLE}\)"), _md_link, "md_link"),
    ("](", re.compile(rf"\]\({_URL}\)?"), _md_open_link, "md_link"),
    ("//", re.compile(r"\[(?:https?:)?//[^\[\]\s]+[ \t]*([^\[\]\n]*)\]", re.I), "\ue003\\1\ue004", "wiki_external"),
    ("//", re.compile(r"\[(?=(?:https?:)?//[^\]\s])", re.I), "", "wiki_external"),
    ("[^", re.compile(r"\[\^[^\[\]\s]+\]:?"), "", "md_footnote"),
    ("\\", None, None, "latex_command"),  # commands with arguments: _commands
    ("\\", re.compile(r"\\(?:begin|end)\b"), "", "latex_environment"),
    ("\\", re.compile(rf"(?<![A-Za-z0-9:\\])\\({BARE})(?![A-Za-z])"), lambda m: SIGNS.get(m[1], ""), "latex_command"),
    ("\\", re.compile(r"\\[()\[\]]"), "", "latex_formula"),
    ("\\", re.compile(r"\\([%&_#$~,;])"), lambda m: " " if m[1] in ",;" else m[1], "latex_escape"),
    ("\\\\", re.compile(r"\\\\[ \t]*\Z"), "", "latex_escape"),
    ("$$", re.compile(r"\$\$"), "", "latex_formula"),
    ("```", re.compile(r"`{3,}"), "", "md_fence"),
    ("`", re.compile(r"`([^`\n]+)`"), "\\1", "md_code"),
    ("*", re.compile(r"\*\*\*?(?=\S)([^*\n]+?)(?<=\S)\*\*\*?"), "\\1", "md_strong"),
    ("*", re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*(?<=[^\s*]))\*(?![\w*])"), "\\1", "md_emphasis"),
    ("__", None, None, "md_strong"),  # pairs with the nearest closing mark of the line: _underlined
    ("*", re.compile(r"(?<=[^\W\d_])\*([^\W\d_]{2,})\*(?=[^\W\d_])"), "\\1", "md_emphasis"),
    ("*", re.compile(_BY_HAN.format(m=r"\*")), lambda m: m[0].replace("*", ""), "md_emphasis"),
    ("__", re.compile(_BY_HAN.format(m="__")), lambda m: m[0].replace("__", ""), "md_strong"),
    ("_", re.compile(r"(?<![\w\\])_(?=[^\s_])([^_\n]*(?<=[^\s_]))_(?!\w)"), "\\1", "md_emphasis"),
    ("**", re.compile(r"\*\*"), "", "md_strong"),
    ("~~", re.compile(r"~~"), "", "md_strike"),
    ("''", re.compile(r"'{2,}"), "", "wiki_quote"),
    ("__", re.compile(r"__[A-Z]{3,}__"), "", "wiki_magic"),
    ("#", re.compile(r"#redirect\b", re.I), "", "wiki_redirect"),
    ("[[", re.compile(r"\[\[(?:[^\[\]|\n]*\|)?"), "", "wiki_link"),
    ("]]", re.compile(r"\]\]"), "", "wiki_link"),
    ("{{", re.compile(r"\{\{(?:Infobox\b|lang\|[a-z]{2,3}\|)?"), "", "wiki_template"),
    ("}}", re.compile(r"\}\}"), "", "wiki_template"),
    (":", re.compile(rf"(?<!\w)(?:{NAMESPACES}):(?=\S)", re.I), "", "wiki_namespace"),
    ("<", re.compile(rf"</?(?:{NAMES})(?=[\s/<>]|\Z){_ATTRIBUTES}\s*/?>?", re.I), "", "html_broken_tag"),
    ("--", re.compile(r"<!--|-->"), "", "html_comment"),
]
_COMMAND = re.compile(r"~?\\{1,2}([A-Za-z]+)\*?(?:(\[[^\[\]\n]*\])?(\{)|\[[^\[\]\n]*\]?)|[{}]")
_OPENED, _CLOSED = re.compile(r"(?<!\w)__(?=[^\W_])"), re.compile(r"(?<=[^\s_])__(?!\w)")


def _commands(text: str) -> tuple[str, set[str]]:
    """LaTeX commands with arguments give way to the text they show, by one pass over the braces;
    braces that belong to none stay."""
    stack: list[tuple[str, list[str]]] = [("", [])]
    found: set[str] = set()
    at, linked = 0, -1
    for m in _COMMAND.finditer(text):
        stack[-1][1].append(text[at : m.start()])
        at = m.end()
        if m[1]:
            found.add("latex_environment" if m[1] in ("begin", "end") else "latex_command")
            if m[0][0] == "~" and m[1] not in UNSHOWN:
                stack[-1][1].append(" ")
            if m[3]:
                stack.append((m[1], []))
        elif m[0] == "{":
            stack.append(("href text" if linked == m.start() else "{", []))
        elif len(stack) > 1:
            name, parts = stack.pop()
            body = "".join(parts)
            if name == "{":
                body = "{" + body + "}"
            elif name == "href":
                linked, body = m.end(), ""
            elif name == "href text":
                body = f"\ue003{body}\ue004"
            elif name in UNSHOWN:
                body = ""
            stack[-1][1].append(body)
        else:
            stack[-1][1].append("}")
    stack[-1][1].append(text[at:])
    return "".join(("{" if name == "{" else "") + "".join(parts) for name, parts in stack), found


def _underlined(text: str) -> tuple[str, bool]:
    """``__x__`` without its marks: each opening one with the nearest closing one of its line."""
    closed = [m.start() for m in _CLOSED.finditer(text)]
    out, at, k = [], 0, 0
    for m in _OPENED.finditer(text):
        if m.start() < at:
            continue
        while k < len(closed) and closed[k] < m.end() + 1:
            k += 1
        if k == len(closed):
            break
        if "\n" not in text[m.end() : closed[k]]:
            out += [text[at : m.start()], text[m.end() : closed[k]]]
            at = closed[k] + 2
    return "".join(out) + text[at:], bool(out)


_BLANKS = re.compile(r"[ \t\u00a0]+")
_LINKED = re.compile("([\ue002\ue003])([^\ue002-\ue004]*)\ue004")
_LINK_MARKS = re.compile("[\ue002-\ue004]")


class _Parser:
    """Builds the tree of one text."""

    def __init__(self) -> None:
        self.keep = _Holder()
        #: Origins of markup that left nothing to show; the next container takes them up.
        self.left: set[str] = set()

    def leaf(self, kind: str, text: str, level: int = 0, number: int = 0, made_of: set[str] = frozenset()) -> Node | None:
        """A leaf of clean running text; none, and its origins in ``self.left``, where nothing is
        left to show. Links of wikitext stand in sentences and name what these speak of: they
        count half."""
        found = set(made_of)
        if _SIGNS.search(text):
            found |= {_ORIGIN_OF[s] for s in set(_SIGNS.findall(text)) if s in _ORIGIN_OF}
            text = _SIGNS.sub("", text)
        for need, pattern, by, origin in _INLINE:
            if need not in text:
                continue
            if pattern is not None:
                shown = pattern.sub(by, text)
                if shown != text:
                    found.add(origin)
                    text = shown
            elif need == "\\":
                text, named = _commands(text)
                found |= named
            else:
                text, hit = _underlined(text)
                if hit:
                    found.add(origin)
        link, links = 0.0, 0
        if _LINK_MARKS.search(text):
            for mark, linked in _LINKED.findall(text):
                link += len(linked) * (0.5 if mark == "\ue002" else 1.0)
                links += 1
            text = _LINK_MARKS.sub("", text)
        found |= self.keep.origins(text)
        text = _BLANKS.sub(" ", text).strip()
        if not text:
            self.left |= found
            return None
        return Node(kind, text, level, link, links, number, found)

    def row(self, cells: list[str], origin: str) -> Node | None:
        shown = [c for c in (self.leaf("para", c, made_of={origin}) for c in cells) if c]
        if not shown:
            self.left.add(origin)
            return None
        return Node("row", " | ".join(c.text for c in shown), 0, sum(c.link for c in shown), sum(c.links for c in shown), 0, set().union(*(c.made_of for c in shown)))

    # ------------------------------------------------------------ lines

    def blocks(self, text: str) -> list[Node]:
        """Blocks of running text: lines tell headings, items, rows; blank lines part paragraphs;
        neighbouring items are one list, neighbouring rows one table."""
        out: list[Node] = []
        lines: list[str] = []
        of_lines: set[str] = set()
        in_table = md_table = False
        environments: list[str] = []
        counters: dict[int, int] = {}

        def add(node: Node | None) -> None:
            if node is None:
                return
            name = {"item": "list", "row": "table"}.get(node.kind)
            if not name:
                out.append(node)
                return
            if not (out and out[-1].kind == "box" and out[-1].text == name):
                out.append(Node("box", name))
            out[-1].children.append(node)

        def flush() -> None:
            nonlocal of_lines
            if lines:
                add(self.leaf("para", "\n".join(lines), made_of=of_lines))
                lines.clear()
            else:
                self.left |= of_lines
            of_lines = set()

        raws = text.split("\n")
        for i, raw in enumerate(raws):
            signs: set[str] = set()
            if _SIGNS.search(raw):
                signs = {_ORIGIN_OF[s] for s in set(_SIGNS.findall(raw)) if s in _ORIGIN_OF}
                raw = _SIGNS.sub("", raw)
                raws[i] = raw
            line = raw.strip()
            if not line:
                self.left |= signs
                flush()
                md_table = False
                continue
            first = line[0]
            if first == "\ue000" and (m := _HOLD.fullmatch(line)):
                flush()
                out.append(Node("code", line, made_of=signs | self.keep.origins(line)))
                continue
            if first == "\\":
                if m := _ENVIRONMENT.match(line):
                    flush()
                    self.left |= signs | {"latex_environment"}
                    if m[1] == "begin":
                        environments.append(m[2])
                        counters.pop(100 + len(environments), None)
                    elif environments:
                        environments.pop()
                    continue
                if m := _LATEX_HEADING.match(line):
                    flush()
                    add(self.leaf("heading", m[2], _LATEX_LEVEL[m[1]], made_of=signs | {"latex_command"}))
                    continue
                if m := _LATEX_ITEM.match(line):
                    flush()
                    depth, number = max(1, len(environments)), 0
                    if environments and environments[-1] == "enumerate":
                        number = counters[100 + depth] = counters.get(100 + depth, 0) + 1
                    add(self.leaf("item", m[1], depth, number, signs | {"latex_command"}))
                    continue
            elif first == "#" and (m := _MD_HEADING.match(raw)):
                flush()
                beside = [raws[j] for j in (i - 1, i + 1) if 0 <= j < len(raws)]
                if len(m[1]) == 1 and any(b.startswith("# ") for b in beside):  # an ordered list of wikitext
                    counters[1] = counters.get(1, 0) + 1 if i and raws[i - 1].startswith("# ") else 1
                    add(self.leaf("item", m[2], 1, counters[1], signs | {"wiki_list"}))
                else:
                    add(self.leaf("heading", re.sub(r"[ \t]+#+$", "", m[2]), len(m[1]), made_of=signs | {"md_heading"}))
                continue
            elif first == "=":
                if _EQUALS.match(raw):
                    signs.add("md_heading")
                    if len(lines) == 1:  # a line underlined is a heading
                        add(self.leaf("heading", lines.pop(), 1, made_of=signs | of_lines))
                        of_lines = set()
                    else:
                        of_lines |= signs
                    flush()
                    continue
                if m := _WIKI_HEADING.match(raw):
                    flush()
                    add(self.leaf("heading", m[2], len(m[1]), made_of=signs | {"wiki_heading"}))
                    continue
            if first in "{|!" and (first != "!" or in_table or (_BANG_ROW.match(raw) and i + 1 < len(raws) and _SIGNS.sub("", raws[i + 1]).startswith("|"))):
                if first == "{" and line.startswith("{|") and raw.lstrip(" ").startswith("{|"):
                    flush()
                    in_table = True
                    self.left |= signs | {"wiki_table"}
                    continue
                if first == "!" or (first == "|" and (in_table or _PIPE_ROW.match(raw))) and not _MD_RULE_ROW.match(raw):
                    flush()
                    if line.startswith(("|}", "|-")):
                        in_table = in_table and not line.startswith("|}")
                        self.left |= signs | {"wiki_table"}
                    elif line.startswith("|+"):
                        add(self.leaf("para", line[2:], made_of=signs | {"wiki_table"}))
                    else:
                        add(self._row_of(line, signs, md_table))
                    continue
            if _MD_RULE_ROW.match(raw):
                signs.add("md_table")
                if lines and "|" in lines[-1]:
                    head = lines.pop()
                    flush()
                    add(self.row(_CELL.split(head), "md_table"))
                else:
                    flush()
                md_table = True
                self.left |= signs
                continue
            if md_table and "|" in line:
                flush()
                add(self._row_of(line, signs, True))
                continue
            if first == "-" and _DASHES.match(raw):
                signs.add("md_rule")
                if len(lines) == 1:
                    add(self.leaf("heading", lines.pop(), 2, made_of=signs | of_lines))
                    of_lines = set()
                else:
                    of_lines |= signs
                flush()
                continue
            if first in _ITEM_FIRST and (item := self._item(raw, line, raws, i, counters)):
                flush()
                add(self.leaf("item", item[0], item[1], item[2], signs | item[3]))
                continue
            if first == ">" and (line == ">" or line[1] == " "):
                if raw.startswith("> ") and len(line) > 1:
                    signs.add("md_quote")
                line = line[1:].strip()
            elif first == "[" and _MD_DEFINITION.match(raw) and line[1] != "^":
                self.left |= signs | {"md_link"}
                continue
            if "||" in line and _DOUBLE_PIPE.search(line):
                flush()
                add(self.row(line.split("||"), "wiki_table"))
                self.left |= signs
                continue
            if line.endswith("==") and (m := _WIKI_HEADING_END.search(line)):
                signs.add("wiki_heading")
                line = line[: m.start() + 1].strip()
            of_lines |= signs
            lines.append(line)
        flush()
        return out

    def _row_of(self, line: str, signs: set[str], md: bool) -> Node | None:
        self.left |= signs
        return self.row(_CELL.split(line.strip("|! ")), "md_table" if md else "wiki_table")

    @staticmethod
    def _item(raw: str, line: str, raws: list[str], i: int, counters: dict[int, int]) -> tuple[str, int, int, set[str]] | None:
        """``(text, level, number, origins)`` of a line that is an item of a list."""
        if m := _MD_ITEM.match(raw):
            return m[3], max(len(m[2]) if m[2][0] == "*" else 1, 1 + len(m[1]) // 2), 0, {"md_list"}
        if m := _WIKI_ITEM.match(line):
            level = len(m[1])
            number = 0
            if m[1][-1] == "#":
                number = counters[level] = counters.get(level, 0) + 1 if i and raws[i - 1].lstrip().startswith(m[1]) else 1
            return m[2], level, number, set()
        if m := _NUMBER_ITEM.match(line):
            beside = [x for j in (i - 1, i + 1) if 0 <= j < len(raws) and (x := _NUMBER_ITEM.match(raws[j].strip()))]
            if not beside:
                return None
            listed = m[2] == "." and any(x[2] == "." for x in beside)
            return m[3], 1 + (len(raw) - len(raw.lstrip())) // 3, int(m[1]), {"md_list"} if listed else set()
        if m := _TERM_ITEM.match(line):
            return m[2], len(m[1]), 0, {"wiki_list"} if _TERM_BLANK.match(raw) else set()
        if m := _BULLET.match(line):
            return m[1], 1, 0, set()
        return None

    # ------------------------------------------------------------ tags

    def tree(self, text: str) -> Node:
        """The tree of a text: boxes of HTML with the blocks of the text between their tags."""
        root = Node("box", "body")
        stack = [root]
        run: list[str] = []
        kind, level, number = "para", 0, 0
        of_run: set[str] = set()
        names: Counter[str] = Counter()  # open boxes by name
        lists: list[tuple[int, Node]] = []  # open lists and their places in the stack

        def close_run() -> None:
            nonlocal kind, level, number, of_run
            body = "".join(run)
            run.clear()
            before, made = len(stack[-1].children), []
            if body.strip():
                if kind == "para":
                    made = self.blocks(body)
                elif kind == "row":
                    made = [n for n in [self.row(body.replace("\n", " ").split("\ue001\ue001"), "html_tag")] if n]
                else:
                    made = [n for n in [self.leaf(kind, " ".join(body.split("\n")), level, number)] if n]
                stack[-1].children += made
            elif _SIGNS.search(body):
                self.left |= {_ORIGIN_OF[s] for s in set(_SIGNS.findall(body)) if s in _ORIGIN_OF}
            (stack[-1].children[before] if made else stack[-1]).made_of |= of_run
            stack[-1].made_of |= self.left
            self.left, of_run = set(), set()
            kind, level, number = "para", 0, 0

        at = 0
        for m in _TAG.finditer(text) if "<" in text else ():
            name = m[2].lower()
            if name not in _KNOWN:
                if not (m[1] and not m[3].strip() and m[2].isalnum()) and not _GIVEN.fullmatch(m[3]):
                    continue
                run.append(text[at : m.start()])
                at = m.end()
                of_run.add("html_tag")
                continue
            run.append(text[at : m.start()])
            at = m.end()
            closing = bool(m[1])
            if name in _BLOCK_SET and name not in ("td", "th", "hr"):
                close_run()
                if name not in _BOXES or (closing and not names[name]):
                    of_run.add("html_tag")
                if name in _BOXES:
                    if closing:
                        while names[name]:
                            names[stack[-1].text] -= 1
                            if stack.pop().text == name:
                                break
                        while lists and lists[-1][0] >= len(stack):
                            lists.pop()
                    else:
                        box = Node("box", name, made_of={"html_tag"})
                        stack[-1].children.append(box)
                        if name in _LISTS:
                            lists.append((len(stack), box))
                        stack.append(box)
                        names[name] += 1
                elif not closing:
                    if name[0] == "h" and name[1:].isdigit():
                        kind, level = "heading", int(name[1:])
                    elif name in ("li", "dt", "dd"):
                        kind, level = "item", max(1, len(lists))
                        if lists and lists[-1][1].text == "ol":
                            lists[-1][1].level += 1
                            number = lists[-1][1].level
                    elif name == "tr":
                        kind = "row"
                continue
            of_run.add("html_tag")
            if name == "a":
                run.append("\ue004" if closing else "\ue003")
            elif name in ("br", "hr"):
                run.append("\n" if kind == "para" else " ")
            elif name in ("td", "th"):
                if closing and kind == "row":
                    run.append("\ue001\ue001")
        run.append(text[at:])
        close_run()
        return root


_MD_HEADING = re.compile(r" {0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*$")
_WIKI_HEADING = re.compile(r"(={2,6})[ \t]*([^=\s](?:.*?[^=\s])?)[ \t]*=*[ \t]*$")
_WIKI_HEADING_END = re.compile(r"[^=]={2,6}$")
_LATEX_HEADING = re.compile(r"\\(chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}?[ \t]*$")
_LATEX_LEVEL = {"chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
_LATEX_ITEM = re.compile(r"\\item\b(?:\[[^\[\]]*\])?[ \t]*(\S.*)$")
_ENVIRONMENT = re.compile(r"\\(begin|end)\{(itemize|enumerate|description)\}(?:\[[^\[\]]*\])?[ \t]*$")
_EQUALS, _DASHES = re.compile(r"={3,}[ \t]*$"), re.compile(r"-{3,}[ \t]*$")
_ITEM_FIRST = set("*#-+•:;0123456789")
_MD_ITEM = re.compile(r"( *)(-|\*+|\+) +(\S.*)$")
_WIKI_ITEM = re.compile(r"([*#]*[*#])(?:(?<=#)[ \t]+|(?=\[\[))[ \t]*(\S.*)$")
_NUMBER_ITEM = re.compile(r"(\d{1,3})([.)])[ \t]+(\S.*)$")
_TERM_ITEM, _TERM_BLANK = re.compile(r"([:;]+)[ \t]*(\S.*)$"), re.compile(r"[:;]+ +\S")
_BULLET = re.compile(r"•[ \t]+(\S.*)$")
_BANG_ROW, _PIPE_ROW = re.compile(r"![ \t]+\S"), re.compile(r"\|(?:\}|-|\+|[ \t]+\S)")
_MD_RULE_ROW = re.compile(r"[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*\|")
_MD_DEFINITION = re.compile(r"\[[^\]]+\]:\s+\S")
_DOUBLE_PIPE = re.compile(r"\S[ \t]*\|\|[ \t]*\S")
_CELL = re.compile(r"\|\||!!|(?<!\|)\|(?!\|)")
_TAG = re.compile(r"<(/?)([A-Za-z][\w-]*)(?=[\s/>])([^<>]*)>")
_GIVEN = re.compile(r"(?:\s+[\w:-]+\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'))+\s*/?")
_BOXES = {"html", "body", "div", "article", "section", "main", "aside", "nav", "header", "footer", "form", "center", "blockquote", "table", "tbody", "thead", "tfoot", "ul", "ol", "dl", "figure"}
_LISTS = {"ul", "ol", "dl"}
_KNOWN = {*BLOCKS, *INLINE}
_BLOCK_SET = set(BLOCKS)


def _nest_sections(root: Node) -> None:
    """Make what follows a heading, up to the next of its level or above, a section with it."""
    for box in walk(root):
        if box.kind != "box" or all(c.kind != "heading" for c in box.children):
            continue
        outer: list[Node] = []
        open_: list[Node] = []
        for c in box.children:
            if c.kind == "heading":
                while open_ and open_[-1].level >= c.level:
                    open_.pop()
                section = Node("box", "part", c.level)
                (open_[-1].children if open_ else outer).append(section)
                open_.append(section)
            (open_[-1].children if open_ else outer).append(c)
        box.children = outer


def parse(text: str) -> tuple[Node, _Holder]:
    """The tree of a text of any of the four syntaxes, and the code and formulas set aside."""
    parser = _Parser()
    text = _PRIVATE.sub("", text.replace("\r\n", "\n"))
    if "<" in text:
        text = _no_unseen(text, " ", _UNSEEN[:1])
    text = parser.keep.hold(text)
    if "&" in text:
        text = _unescape(text)
    if "<" in text:
        text = _no_unseen(text, "", _UNSEEN)
    if "\\begin" in text:
        text = _TABULAR.sub(_tabular, text)
    if "{{" in text:
        text = _templates(text)
    root = parser.tree(text)
    _nest_sections(root)
    return root, parser.keep


# ---------------------------------------------------------------- main content

_COMMAS = re.compile("[,，、;；]")
#: Containers that are no place of their own: the one around them is.
_LIKE_TEXT = {"ul", "ol", "dl", "table", "tbody", "thead", "blockquote", "figure", "list"}
#: Points reach so many ancestors, by these shares.
_REACH = (1, 0.5, 0.25)


def _score(root: Node) -> dict[int, Node]:
    """Points, sizes and linked characters of all nodes; gives the parent of each."""
    nodes = walk(root)
    parent = {id(c): n for n in nodes for c in n.children}
    for n in reversed(nodes):
        if n.kind in ("para", "item") and len(n.text) >= 25:
            points = 1 + len(_COMMAS.findall(n.text)) + min(len(n.text) // 100, 3)
            up = n
            for share in _REACH:
                up = parent.get(id(up))
                if up is None:
                    break
                up.score += points * share
        up = parent.get(id(n))
        if up is not None:
            up.size += n.size
            up.link += n.link
            up.links += n.links
    return parent


def _is_links(n: Node) -> bool:
    return n.kind in ("para", "item") and n.links > 0 and n.link > 0.8 * n.size


def _main_content(root: Node) -> list[Node]:
    """The leaves of the best container and of those of its siblings that carry text, at every
    height up to the root, so that no text beside the best place is lost. Without any paragraph
    worth a point all leaves stay."""
    parent = _score(root)
    nodes = walk(root)
    boxes = [n for n in nodes if n.kind == "box"]
    value = lambda b: b.score * (1 - (b.link / b.size if b.size else 0.0))
    best = max(boxes, key=value)
    if value(best) > 0:
        top = value(best)
        while best.text in _LIKE_TEXT and id(best) in parent:
            best = parent[id(best)]
        # lists and boxes made of links, and neighbouring paragraphs of links, are menus
        for b in boxes:
            dense = [_is_links(c) for c in b.children]
            for i, c in enumerate(b.children):
                if c.kind == "box":
                    c.gone = c.link > 0.5 * c.size and len(c.children) > 1
                elif b.text not in _LIKE_TEXT:
                    c.gone = dense[i] and (c.links > 1 or (i > 0 and dense[i - 1]) or (i + 1 < len(dense) and dense[i + 1]))
        inner: Node = best
        while id(inner) in parent:
            for c in parent[id(inner)].children:
                if c is not inner and c.kind == "box" and not (value(c) >= 0.2 * top or c.link <= 0.5 * c.size):
                    c.gone = True
            inner = parent[id(inner)]
            inner.gone = False
        best.gone = False
        # a heading whose part is gone goes with it
        for b in reversed(boxes):
            if b.text == "part" and len(b.children) > 1 and all(c.gone for c in b.children[1:]):
                b.gone = True
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        if n.gone:
            continue
        if n.kind == "box":
            stack.extend(reversed(n.children))
        else:
            out.append(n)
    return out


def _render(leaves: list[Node], keep: _Holder) -> str:
    parts, last = [], ""
    for b in leaves:
        text = b.text
        if b.kind == "heading":
            text = "#" * max(1, min(6, b.level)) + " " + text
        elif b.kind == "item":
            text = "  " * max(0, b.level - 1) + (f"{b.number}. " if b.number else "- ") + text
        elif b.kind == "row":
            text = "| " + text.strip(" |") + " |"
        together = b.kind == last and b.kind in ("item", "row")
        parts.append(("\n" if together else "\n\n") + keep.show(text))
        last = b.kind
    return "".join(parts).strip()


def clean(text: str) -> tuple[str, list[str]]:
    """Clean text and constructs of one text; a text whose tree has none comes back unchanged."""
    root, keep = parse(text)
    found = origins(root)
    return (_render(_main_content(root), keep), found) if found else (text, found)


#: Marks that begin a line mean nothing in an entry.
_OF_LINES = {"md_list", "md_heading", "md_rule", "md_quote", "wiki_list"}
_ENTRY_LINK = re.compile(rf"\[\[:?(?:{NAMESPACES}):([^\[\]|]*)(?:\|[^\[\]]*)?\]\]", re.I)
_ENTRY_NAMESPACE = re.compile(rf"^\s*:?(?:{NAMESPACES}):", re.I)
_SORT_KEY = re.compile(r"\|[^|\]}]*$")


def clean_entry(entry: str) -> tuple[str, list[str]]:
    """As :func:`clean` for a short entry such as a category: one line without namespace and sort
    key, in which marks that begin a line mean nothing."""
    found = {"wiki_sort_key"} if "|" in entry else set()
    text = _PRIVATE.sub("", entry)
    for pattern, by, origin in ((_ENTRY_LINK, r"\1", "wiki_link"), (_ENTRY_NAMESPACE, "", "wiki_namespace"), (_SORT_KEY, "", "wiki_sort_key")):
        bare = pattern.sub(by, text)
        if bare != text:
            found.add(origin)
            text = bare
    parser = _Parser()
    if "<" in text:
        text = _no_unseen(text, " ", _UNSEEN[:1])
    text = parser.keep.hold(text)
    text = _templates(_no_unseen(_unescape(text), "", _UNSEEN)) if "{{" in text or "<" in text or "&" in text else text
    root = parser.tree(" ".join(text.split()))
    found |= set(origins(root)) - _OF_LINES
    if not found:
        return entry, []
    leaves = [n for n in walk(root) if n.kind != "box"]
    return " ".join(_render(leaves, parser.keep).lstrip("-# ").split()), sorted(found)


# ---------------------------------------------------------------- the operator

#: A text without any of these characters holds no construct.
SUSPECT = r"[<>&\[\]{}|*_`\\$~#=:]|''|(?m)^ *(-|\+|\d{1,3}\.) |^---|-->"

RESULT = "clean string, constructs array<string>"


def clean_markup(df: DataFrame, text_col: str = "text", clean_col: str = "clean_text", found_col: str = "constructs", entries: bool = False) -> DataFrame:
    """Add the clean text and the names of the constructs found (empty: none) to each row.

    A null text stays null with no constructs; an empty or blank one stays as it is. Rows whose
    text has none of the characters a construct needs never leave the JVM. Columns named like the
    outputs are replaced, all others kept. With ``entries`` the texts are short entries, such as
    categories. An empty table gives no rows.
    """
    one = clean_entry if entries else clean

    @F.pandas_udf(RESULT)
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            done = [(None, []) if t is None else one(t) for t in texts]
            yield pd.DataFrame({"clean": [d[0] for d in done], "constructs": [d[1] for d in done]})

    text = F.col(text_col)
    marked = df.withColumn("_done", convert(F.when(text.rlike(SUSPECT), text)))
    return marked.withColumns({clean_col: F.coalesce("_done.clean", text), found_col: F.coalesce("_done.constructs", F.array().cast("array<string>"))}).drop("_done")
