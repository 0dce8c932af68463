"""Layout-aware text of web pages.

A tolerant tree builder supplies the tags that pages leave out, visibility rules cut what a
reader does not see, and a renderer lays the rest out in lines: blocks on lines of their own,
list items with their marks, table cells aligned in columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stacktally.llm.common import whole

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(
    "head title style script noscript template iframe object audio video canvas datalist".split()
)
RAW_TEXT = frozenset("script style textarea title iframe noscript".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol "
    "p pre search section summary table caption ul option optgroup textarea".split()
)
# Blocks with an empty line around them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
ENDS_P = BLOCK - frozenset("html body li dd dt caption legend summary option optgroup textarea".split())
# An opening tag ends these, up to the nearest of the second set.
IMPLIED_END = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
SCOPE = frozenset(["table", "td", "th", "caption", "button", "object", "template", "html"])

_WHITE = re.compile(r"[ \t\n\f\r]+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(hidden|collapse)", re.IGNORECASE)
# A column is not padded beyond this, so one long cell does not widen a table without bound.
WIDEST_COLUMN = 60
# Tables nested deeper are laid out as plain blocks.
DEEPEST_TABLE = 20


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str | None]):
        self.tag, self.attributes = tag, attributes
        self.children: list[Node | str] = []

    @property
    def hidden(self) -> bool:
        a = self.attributes
        return (
            self.tag in HIDDEN or "hidden" in a or (a.get("aria-hidden") or "").lower() == "true"
            or bool(_INVISIBLE.search(a.get("style") or ""))
            or (self.tag == "input") or (self.tag == "dialog" and "open" not in a)
        )


class Builder(HTMLParser):
    """Builds the tree; every end that a page leaves out is supplied."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.count: dict[str, int] = {"html": 1}

    def _close(self, index: int) -> None:
        for node in self.open[index:]:
            self.count[node.tag] -= 1
        del self.open[index:]

    def _end(self, tags: frozenset, until: frozenset) -> None:
        """Closes the outermost open element of ``tags`` above the nearest of ``until``."""
        if not any(self.count.get(t) for t in tags):
            return
        found = None
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in until:
                break
            if self.open[i].tag in tags:
                found = i
        if found is not None:
            self._close(found)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        attributes = dict(attrs)
        if tag in ("html", "body"):
            if tag == "body":
                self._end(frozenset(["head"]), frozenset())
            for node in self.open[:1]:
                node.attributes = {**attributes, **node.attributes}
            return
        if tag in IMPLIED_END:
            self._end(*IMPLIED_END[tag])
        elif tag in ENDS_P:
            self._end(frozenset(["p", "head"]), SCOPE - {"html"})
        if tag in ("td", "th") and self.count.get("table") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self._push("tr", {})
        node = Node(tag, attributes)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self._push(tag, attributes, node)

    def _push(self, tag: str, attributes: dict, node: Node | None = None) -> None:
        if node is None:
            node = Node(tag, attributes)
            self.open[-1].children.append(node)
        self.open.append(node)
        self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
        if not self.count.get(tag) or tag in ("html", "body"):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._close(i)
                return
            # A stray end of something inside a cell does not close the cell.
            if self.open[i].tag in ("td", "th", "table") and tag not in ("table", "tr", "thead", "tbody", "tfoot"):
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)

    def parse_html_declaration(self, i: int) -> int:
        """A comment, a doctype or, in a browser as here, a bogus comment up to the next bracket.

        What the page does not end goes on to its end. The standard parser asserts in marked
        sections, so these are not handed to it.
        """
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        return self._end_or_rest(self.rawdata.find(">", i + 2) + 1 or -1)

    def _end_or_rest(self, end: int) -> int:
        return len(self.rawdata) if end < 0 and self.at_end else end

    def parse_comment(self, i: int, report: int = 1) -> int:
        return self._end_or_rest(super().parse_comment(i, report))

    def parse_pi(self, i: int) -> int:
        return self._end_or_rest(super().parse_pi(i))

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_html_declaration(i)

    def goahead(self, end: bool) -> None:
        self.at_end = end
        super().goahead(end)


class Layout:
    """Lines of text: words joined by single spaces, blocks apart, at most one empty line."""

    def __init__(self, depth: int = 0) -> None:
        self.depth = depth  # tables around this one
        self.lines: list[str] = []
        self.current: list[str] = []
        self.blank = False  # an empty line is due before the next text
        self.space = False  # a space is due before the next word
        self.indents: list[str] = []
        self.mark = ""

    def _prefix(self) -> str:
        if self.mark:
            prefix, self.mark = "".join(self.indents[:-1]) + self.mark, ""
            return prefix
        return "".join(self.indents)

    def _start(self) -> None:
        if not self.current:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = self.space = False
            self.current.append(self._prefix())

    def text(self, data: str) -> None:
        words = _WHITE.split(data)
        if words == ["", ""] or words == [""]:
            self.space = self.space or (bool(self.current) and len(words) > 1)
            return
        led, trailed = words[0] == "", words[-1] == ""
        inner = " ".join(x for x in words if x)
        had = bool(self.current)
        self._start()
        self.current.append((" " if had and (self.space or led) else "") + inner)
        self.space = trailed

    def verbatim(self, data: str) -> None:
        for i, line in enumerate(data.split("\n")):
            if i:
                self.line(keep_empty=True)
            if line:
                self._start()
                self.current.append(line.rstrip("\r"))

    def line(self, keep_empty: bool = False) -> None:
        if self.current:
            self.lines.append("".join(self.current).rstrip())
            self.current = []
        elif keep_empty and self.lines and not self.blank:
            self.lines.append("")
        self.space = False

    def block(self, spaced: bool) -> None:
        self.line()
        self.blank = self.blank or spaced

    def done(self) -> str:
        self.line()
        return "\n".join(self.lines).strip("\n")


def _inside(top: Node, wanted: tuple[str, ...], through: tuple[str, ...]) -> tuple[list[Node], list[Node | str]]:
    """The visible ``wanted`` elements below ``top``, and what stands beside them.

    Goes through elements of ``through``, and through any other that holds a wanted one in a form, as
    old pages have it; not into tables within.
    """
    found, stray = [], []
    waiting = list(reversed(top.children))
    while waiting:
        node = waiting.pop()
        if isinstance(node, str):
            if node.strip():
                stray.append(node)
        elif node.hidden or node.tag in ("caption", "colgroup", "col"):
            continue
        elif node.tag in wanted:
            found.append(node)
        elif node.tag in through or node.tag == "form":
            waiting += reversed(node.children)
        else:
            stray.append(node)
    return found, stray


def _span(cell: Node) -> int:
    value = cell.attributes.get("colspan") or ""
    return min(int(value), 100) if value.isascii() and value.isdigit() and len(value) < 5 and int(value) else 1


def _table(node: Node, layout: Layout) -> None:
    for child in node.children:
        if not isinstance(child, str) and child.tag == "caption" and not child.hidden:
            layout.block(False)
            layout.text(" ".join(render(child, layout.depth + 1).split("\n")))
            layout.block(False)
    grid: list[list[tuple[str, int]]] = []
    # Cells without a row, as a form between table and row leaves them, are a row of one cell each.
    rows, stray = _inside(node, ("tr", "td", "th"), ("thead", "tbody", "tfoot"))
    for row in rows:
        cells, beside = ([row], []) if row.tag != "tr" else _inside(row, ("td", "th"), ())
        stray += beside
        texts = [(" ".join(x for x in render(c, layout.depth + 1).split("\n") if x), _span(c)) for c in cells]
        if any(t for t, _ in texts):
            grid.append(texts)
    widths: dict[int, int] = {}
    for row in grid:
        at = 0
        for text, span in row:
            if span == 1:
                widths[at] = max(widths.get(at, 0), min(len(text), WIDEST_COLUMN))
            at += span
    for row in grid:
        at, parts = 0, []
        for text, span in row:
            room = sum(widths.get(i, 0) for i in range(at, at + span)) + 3 * (span - 1)
            parts.append(text.ljust(room))
            at += span
        layout.verbatim(" | ".join(parts).rstrip())
        layout.line()
    # Text that stands in a table outside its cells is visible too. A table that stands there is one
    # deeper, so that tables directly in tables end like those in cells.
    layout.depth += 1
    for child in stray:
        _walk(child, layout)
    layout.depth -= 1


def _walk(top: Node | str, layout: Layout) -> None:
    """Lays out a subtree; a stack in place of recursion, as trees may be deep."""
    stack: list[tuple[str, Node | str, object]] = [("open", top, None)]
    while stack:
        what, node, extra = stack.pop()
        if isinstance(node, str):
            (layout.verbatim if extra else layout.text)(node)
            continue
        tag = node.tag
        if what == "close":
            if tag in ("ul", "ol", "menu", "dir", "blockquote", "dd"):
                layout.line()
                layout.indents.pop()
            if tag == "li":
                layout.line()
                layout.indents.pop()
                layout.mark = ""
            if tag == "q":
                layout.text("”")
            if tag in BLOCK:
                nested = tag in ("ul", "ol", "menu") and len(layout.indents) > 0
                layout.block(tag in SPACED and not nested)
            continue
        if node.hidden:
            continue
        if tag == "br":
            layout._start()
            layout.line()
            continue
        if tag == "img":
            if alt := (node.attributes.get("alt") or "").strip():
                layout.text(alt)
            continue
        if tag == "hr":
            layout.block(True)
            continue
        if tag in BLOCK:
            nested = tag in ("ul", "ol", "menu") and len(layout.indents) > 0
            layout.block(tag in SPACED and not nested)
        if tag == "table" and layout.depth < DEEPEST_TABLE:
            _table(node, layout)
            layout.block(True)
            continue
        if tag in ("ul", "ol", "menu", "dir"):
            layout.indents.append("")
        elif tag in ("blockquote", "dd"):
            layout.indents.append("    " if tag == "dd" else "> ")
        elif tag == "li":
            mark = f"{extra}. " if extra else "- "
            layout.indents.append(" " * len(mark))
            layout.mark = mark
        elif tag == "q":
            layout.text("“")
        stack.append(("close", node, None))
        number = node.attributes.get("start") or ""
        number = int(number) if number.isascii() and number.isdigit() and len(number) < 9 else 1
        children = []
        verbatim = extra if tag != "li" and extra is True else tag == "pre"
        for child in node.children:
            info: object = True if verbatim is True else None
            if not isinstance(child, str) and child.tag == "li" and tag == "ol":
                info = number
                number += not child.hidden
            elif not isinstance(child, str) and child.tag == "li":
                info = None
            children.append(("open", child, info))
        stack += reversed(children)


def render(node: Node, depth: int = 0) -> str:
    layout = Layout(depth)
    for child in node.children:
        _walk(child, layout)
    return layout.done()


def extract_text(html: str) -> str:
    """The visible text of a page, laid out in lines."""
    builder = Builder()
    builder.feed(html)
    builder.close()
    return "" if builder.root.hidden else render(builder.root)


def _title(html: str) -> str:
    found = re.search(r"<title[^>]*>([^<]*)", html, re.IGNORECASE)
    if not found:
        return ""
    from html import unescape

    return " ".join(unescape(found.group(1)).split())


_EXTRACTED = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("n_lines", T.LongType()), T.StructField("problem", T.StringType()),
])


@F.pandas_udf(_EXTRACTED)
def _extract(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in pages:
        rows = []
        for html in batch:
            try:
                text, problem = extract_text(html), None
            except Exception as failure:  # one page must not stop the others
                text, problem = "", f"{type(failure).__name__}: {failure}"
            rows.append((_title(html), text, len(text.split("\n")) if text else 0, problem))
        yield pd.DataFrame(rows, columns=["title", "text", "n_lines", "problem"])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with struct ``extracted``: title, text, n_lines and problem.

    A narrow pass, one page at a time, in time and memory in proportion to the page. A null or empty
    page gives empty texts; broken markup gives what a reader would still see. Should a page fail all
    the same, its text is empty and ``problem`` says why (else null). Repeated rows are extracted each; a column
    ``extracted`` of ``pages`` is replaced.
    """
    return pages.withColumn("extracted", _extract(whole(F.col(html))))
