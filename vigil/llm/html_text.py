"""Visible text of web pages, laid out.

A tree is built with implied end tags, parts that a browser does not show are
left out, and the rest is rendered with an explicit stack: blocks on lines of
their own, a blank line around paragraphs, list items marked and indented,
preformatted text kept, table cells in aligned columns.

Defined cases: null or empty html gives empty text; broken, unclosed or deeply
nested markup is rendered as far as it goes; repeated rows are rendered each;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import prepare

# Element kinds of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
UNSEEN = {"head", "script", "style", "template", "noscript", "title", "meta", "link", "object", "iframe", "svg",
          "math", "canvas", "audio", "video", "datalist", "select", "textarea"}
SPACED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "dl", "table", "figure", "hr"}
BLOCK = SPACED | {"html", "body", "div", "section", "article", "aside", "nav", "header", "footer", "main", "address",
                  "form", "fieldset", "legend", "details", "summary", "dialog", "li", "dt", "dd", "caption",
                  "figcaption", "center", "hgroup", "menu", "search", "tr", "thead", "tbody", "tfoot"}
#: A start tag closes an open element of these kinds, up to the border.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
_P_BORDER = {"td", "th", "table", "button", "caption", "object"}
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    """Elements and strings; start tags imply the end of what they cannot be in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]
        self.count: Counter = Counter()          # of open elements by tag

    def _cut(self, k: int) -> None:
        self.count.subtract(n.tag for n in self.open[k:])
        del self.open[k:]

    def _close(self, kinds: set[str], border: set[str]) -> None:
        if not any(self.count[t] for t in kinds):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in kinds:
                # the outermost of these kinds that no border shields
                while k > 1 and self.open[k - 1].tag in kinds:
                    k -= 1
                self._cut(k)
                return
            if self.open[k].tag in border:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in BLOCK:
            self._close({"p"}, _P_BORDER)
        if tag in BLOCK - {"html", "head", "body"} and len(self.open) > 1 and self.open[-1].tag == "head":
            self._cut(len(self.open) - 1)
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)          # "/" means nothing outside void elements

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Node("br", {}))
            return
        if not self.count[tag]:
            return
        border = {"table"} if tag not in ("table", "body", "html") else set()
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                self._cut(k)
                return
            if self.open[k].tag in border:
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return builder.root


def visible(node: Node) -> bool:
    a = node.attrs
    return not (node.tag in UNSEEN or "hidden" in a or _HIDING.search(a.get("style", ""))
                or node.tag == "input" and a.get("type", "").lower() == "hidden"
                or node.tag == "dialog" and "open" not in a)


class _Lines:
    """Text under way: finished lines, the open line, blank lines still due."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False                       # a collapsed blank is due
        self.gap = 0
        self.indent = ""
        self.marker = ""

    def text(self, data: str, pre: bool) -> None:
        if pre:
            first, *rest = data.replace("\r\n", "\n").split("\n")
            self._put(first)
            for part in rest:
                self.newline(keep=True)
                self._put(part)
            return
        words = _BLANKS.split(data)
        if words[0] == "" and len(words) > 1:
            self.space = True
        for k, w in enumerate(words):
            if w:
                if (k or self.space) and self.line:
                    self.line.append(" ")
                self.space = False
                self._put(w)
        if words[-1] == "" and len(words) > 1:
            self.space = True

    def _put(self, piece: str) -> None:
        if piece and not self.line:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = 0
            self.line.append(self.indent + self.marker)
            if self.marker:
                self.indent += " " * len(self.marker)
                self.marker = ""
        if piece:
            self.line.append(piece)

    def newline(self, keep: bool = False) -> None:
        self.space = False
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        elif keep and self.lines:
            self.lines.append("")

    def blank(self) -> None:
        self.newline()
        if not self.marker:                      # the first line of an item follows its mark
            self.gap = 1

    def done(self) -> str:
        self.newline()
        return "\n".join(self.lines).strip("\n")


def _span(value: str) -> int:
    return min(int(value), 1000) if value.isascii() and value.isdigit() and 0 < len(value) < 6 and int(value) else 1


def _table(rows: list[list[tuple[str, int]]]) -> list[str]:
    """Cells (text, columns) in aligned columns, two blanks apart."""
    width: dict[int, int] = {}
    for row in rows:
        col = 0
        for text, n in row:
            if n == 1:
                width[col] = max(width.get(col, 0), len(text))
            col += n
    out = []
    for row in rows:
        line, col = [], 0
        for text, n in row:
            size = sum(width.get(c, 0) for c in range(col, col + n)) + 2 * (n - 1)
            line.append(text.ljust(size))
            col += n
        out.append("  ".join(line).rstrip())
    return out


def render(root: Node) -> str:
    """The visible text below ``root``; nesting uses a list, not the call stack."""
    out = [_Lines()]
    pre = 0
    lists: list[list] = []                       # [kind, next number, indent before]
    tables: list[list] = []                      # rows of each open table
    work: list[tuple] = [("enter", root)]
    while work:
        act, node = work.pop()
        now = out[-1]
        if isinstance(node, str):
            now.text(node, pre > 0)
            continue
        tag = node.tag
        if act == "enter":
            if not visible(node):
                continue
            if tag == "br":
                now.newline(keep=True)
                continue
            if tag == "img" and node.attrs.get("alt", "").strip():
                now.text(node.attrs["alt"], False)
                continue
            if tag == "input" and node.attrs.get("type", "text").lower() in ("text", "submit", "button", "reset"):
                now.text(node.attrs.get("value", ""), False)
                continue
            children = node.children
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            if tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                out.append(_Lines())
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in SPACED and not (tag in ("ul", "ol", "dl") and lists):
                now.blank()
            elif tag in BLOCK:
                now.newline()
            if tag == "table":
                tables.append([])
            elif tag in ("ul", "ol", "menu"):
                first = node.attrs.get("start", "")
                lists.append([tag, int(first) if re.fullmatch(r"-?\d{1,9}", first) else 1, now.indent])
            elif tag == "li":
                if lists and lists[-1][0] == "ol":
                    now.marker = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                else:
                    now.marker = "- "
            elif tag == "dd":
                now.indent += "  "
            elif tag == "pre":
                pre += 1
            work.append(("leave", node))
            work.extend(("enter", c) for c in reversed(children))
            continue
        if tag in ("td", "th") and tables:
            text = " ".join(out.pop().done().split())
            tables[-1][-1].append((text, _span(node.attrs.get("colspan", ""))))
        elif tag == "table":
            for line in _table([r for r in tables.pop() if any(t for t, _ in r)]):
                now._put(line)
                now.newline()
            now.blank()
        elif tag in ("ul", "ol", "menu"):
            now.newline()
            now.indent = lists.pop()[2]
            now.marker = ""
            if not lists:
                now.blank()
        elif tag == "li":
            now.newline()
            now.marker = ""
            if lists:
                now.indent = lists[-1][2]
            else:
                now.indent = ""
        elif tag == "dd":
            now.newline()
            now.indent = now.indent[:-2]
        elif tag == "pre":
            pre -= 1
            now.blank()
        elif tag in SPACED:
            now.blank()
        elif tag in BLOCK:
            now.newline()
    return out[0].done()


def html_to_text(html: str | None) -> str:
    return render(parse(html)) if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and visible text of each page."""
    prepare(pages.sparkSession)
    base = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"page_id": f["page_id"], "text": [html_to_text(h) for h in f["html"]]})

    return base.mapInPandas(run, f"page_id {base.schema['page_id'].dataType.simpleString()}, text string")


def op9_html_text(spark, sf_dir: str) -> DataFrame:
    done = extract(prepare(spark).read.parquet(f"{sf_dir}/pages.parquet"))
    return done.select("page_id", "text", F.length("text").cast("long").alias("n_chars"),
                       F.sha2("text", 256).alias("text_sha256"))
