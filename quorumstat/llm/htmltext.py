"""All visible text of HTML pages, laid out as a reader sees it.

A tree builder with implied end tags places every start tag; hidden subtrees are dropped;
the tree is rendered with blank lines around paragraphs, line breaks around other blocks,
markers and indents for list items, and table cells padded to the width of their columns
(wide characters count as two, spanning cells cover theirs).  A cell wider than MAX_COLUMN
does not widen its column, nothing is padded beyond MAX_LEFT characters of a line, and lists
are indented to MAX_INDENT: so the text of a page stays in proportion to the page.

Edge cases: a null or empty page has empty text; unclosed, stray and misnested tags are
repaired as by their nearest open ancestor; elements may be nested to any depth; of closed details only the
summary shows; of
a select the shown option is text; closed dialogs, and in drawings all but text elements,
are hidden; below visibility: hidden only what is made visible again shows; very long pages
are read whole; repeated rows give equal text; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Generator, Iterator
from html.parser import HTMLParser
from unicodedata import combining, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters: of a column that cells are padded to, of a line up to its last padded place, and of a list's indent.
MAX_COLUMN, MAX_LEFT, MAX_INDENT = 40, 200, 80
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style head template noscript title meta link iframe audio video canvas datalist annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr".split())
BLOCK = SPACED | frozenset("html body div section article aside header footer nav main address form li dt dd tr caption figcaption details summary center menu thead tbody tfoot".split())
SECTIONS = ("thead", "tbody", "tfoot")
#: Below svg, subtrees that are not drawn; and text is drawn only below these.
SVG_HIDDEN, SVG_TEXT = frozenset("defs symbol desc metadata clippath mask marker pattern".split()), ("text", "foreignobject")
#: A start tag ends open elements of these names, unless one of the barriers stands between.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th", "caption", "colgroup"), ("tr", "table")),
    "th": (("td", "th", "caption", "colgroup"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "option": (("option",), ("select",)),
    "body": (("head",), ()),
}
#: Start tags that do not end an open head; any other, and text, does.
IN_HEAD = frozenset("html head base link meta title style script noscript template".split())
_NO_SHOW = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
#: Largest column and row spans that browsers take.
MAX_SPAN = {"colspan": 1000, "rowspan": 65534}
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    """visible: what the element itself says of visibility, None if nothing.  drawing: inside svg, outside its text."""

    __slots__ = ("tag", "children", "hidden", "start", "attrs", "visible", "drawing")

    def __init__(self, tag: str, hidden: bool = False, start: int = 1, attrs: dict | None = None, visible: bool | None = None):
        self.tag, self.children, self.hidden, self.start, self.attrs, self.visible, self.drawing = tag, [], hidden, start, attrs or {}, visible, False


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("body")
        self.open, self.count = [self.root], Counter()

    def _close(self, i: int) -> None:
        for n in self.open[i:]:
            self.count[n.tag] -= 1
        del self.open[i:]

    def _end(self, names: tuple[str, ...], barriers: tuple[str, ...]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in barriers or not any(self.count[x] for x in names):
                return
            if self.open[i].tag in names:
                self._close(i)
                if not any(n.tag in names for n in self.open[max(1, i - 3) :]):
                    return

    def _leave_head(self) -> None:
        if self.open[-1].tag == "head":
            self._end(("head",), ())

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD:
            self._leave_head()
        if tag in IMPLIED:
            self._end(*IMPLIED[tag])
        elif tag in BLOCK and self.count["p"]:
            self._end(("p",), ("td", "th", "table", "button"))
        if tag in ("td", "th") and self.open[-1].tag in ("table", *SECTIONS):
            self._push(Node("tr"))
        a = dict(attrs)
        drawing = self.open[-1].drawing
        if drawing and tag == "text":
            self.open[-1].children.append(" ")
        unseen = tag == "dialog" and "open" not in a or tag == "object" and "data" in a or drawing and tag in SVG_HIDDEN
        hidden = unseen or tag in HIDDEN or "hidden" in a or bool(_NO_SHOW.search(a.get("style") or ""))
        start = int(a["start"]) if tag == "ol" and (a.get("start") or "").lstrip("-").isdigit() and len(a["start"]) < 10 else 1
        said = _VISIBILITY.search(a.get("style") or "")
        node = Node(tag, hidden, start, a if tag in ("select", "option", "td", "th", "li", "details") else None, said and said[1].lower() == "visible")
        if tag not in VOID:
            self._push(node)
        else:
            self.open[-1].children.append(node)

    def _push(self, node: Node) -> None:
        parent = self.open[-1]
        parent.children.append(node)
        node.drawing = node.tag == "svg" or parent.drawing and node.tag not in SVG_TEXT
        self.open.append(node)
        self.count[node.tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and (self.count["svg"] or self.count["math"]):
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag == "br":
            self._leave_head()
            self.open[-1].children.append(Node("br"))
            return
        for i in range(len(self.open) - 1, 0, -1) if self.count[tag] else ():
            if self.open[i].tag == tag:
                self._close(i)
                return
            if self.open[i].tag in ("td", "th", "table") and tag not in ("tr", "thead", "tbody", "tfoot", "table"):
                return

    def handle_data(self, data):
        if _SPACE.sub("", data):
            self._leave_head()
        if not self.open[-1].drawing:
            self.open[-1].children.append(data)


class Page:
    """Lines being written: pending spaces and blank lines are only put out before more text."""

    def __init__(self):
        self.lines, self.line, self.gap, self.space, self.indent, self.mark, self.depth = [], [], 0, False, "", "", 0

    def text(self, data: str, pre: bool) -> None:
        if pre:
            for i, part in enumerate(data.split("\n")):
                if i:
                    self.br(True)
                self._put(part)
            return
        words = _SPACE.sub(" ", data)
        if not words:
            return
        if words[0] == " ":
            self.space, words = bool(self.line), words[1:]
        if words:
            self._put((" " if self.space else "") + words.rstrip(" "))
            self.space = words[-1] == " "

    def _put(self, s: str) -> None:
        if not s:
            return
        if not self.line:
            if self.lines and self.gap:
                self.lines += [""] * self.gap
            self.gap, s = 0, self.indent + self.mark + s.lstrip(" ") if not self.mark == "" else self.indent + s
            self.mark = ""
        self.line.append(s)

    def br(self, keep: bool = False) -> None:
        if self.line or keep and self.lines:
            self.lines.append("".join(self.line).rstrip())
        self.line, self.space = [], False

    def block(self, spaced: bool) -> None:
        self.br()
        self.gap = max(self.gap, int(spaced))


Step = Generator["Step", object, object]


def _run(job: Step) -> object:
    """Runs a generator that yields the generators it waits for: elements nested to any depth need no nested calls."""
    stack, result = [job], None
    while stack:
        try:
            stack.append(stack[-1].send(result))
            result = None
        except StopIteration as end:
            stack.pop()
            result = end.value
    return result


def render(node: Node, page: Page, pre: bool = False, shown: bool = True) -> Step:
    number = node.start
    children = node.children
    if node.tag == "details" and "open" not in node.attrs:
        children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
    for child in children:
        if isinstance(child, str):
            if shown:
                page.text(child, pre)
            continue
        tag = child.tag
        if child.hidden:
            continue
        here = shown if child.visible is None else child.visible
        if tag == "br":
            page.br(True)
        elif tag == "select":
            for option in _shown_options(child):
                page.text(" ", False)
                yield render(option, page, pre, here)
                page.text(" ", False)
        elif tag == "textarea":
            yield render(child, page, True, here)
        elif tag == "table":
            page.block(True)
            yield _table(child, page, here)
            page.block(True)
        elif tag == "li":
            page.block(False)
            outer = page.indent
            value = child.attrs.get("value") or ""
            if node.tag == "ol" and value.lstrip("-").isdigit() and len(value) < 10:
                number = int(value)
            mark = f"{number}. " if node.tag == "ol" else "* "
            number += 1
            page.mark = mark
            page.indent = outer
            yield _item(child, page, outer, mark, pre, here)
        elif tag in BLOCK:
            nested = tag in ("ul", "ol", "menu", "dl") and node.tag in ("li", "dd")
            outer = page.indent
            page.block(tag in SPACED and not nested)
            if tag in ("blockquote", "dd"):
                page.indent = outer + "  " if len(outer) < MAX_INDENT else outer
            yield render(child, page, pre or tag == "pre", here)
            page.block(tag in SPACED and not nested)
            page.indent = outer
        else:
            yield render(child, page, pre, here)


def _item(child: Node, page: Page, outer: str, mark: str, pre: bool, shown: bool) -> Step:
    """A list item: its first line carries the marker, the rest is indented to it."""
    if page.depth >= MAX_INDENT // 2:  # no further indent: the item's lines stand as they are
        page.mark = mark
        yield render(child, page, pre, shown)
        page.block(False)
        return
    before = len(page.lines)
    render_into = Page()
    render_into.depth = page.depth + 1
    yield render(child, render_into, pre, shown)
    render_into.br()
    lines = render_into.lines or [""]
    page.mark = ""
    for i, text in enumerate(lines):
        if i or before >= 0:
            page.br()
        if text or not i:
            room = " " * len(mark) if len(text) - len(text.lstrip(" ")) < MAX_INDENT else ""
            page._put(((mark if not i else room) + text).rstrip())
            page.br()
        else:
            page.lines.append("")


def _shown_options(select: Node) -> list[Node]:
    """All options of a list box; of a drop-down the last selected one, or else the first that is not disabled."""
    todo, options = [select], []
    while todo:
        node = todo.pop()
        if node.tag == "option":
            options.append(node)
        else:
            todo += [c for c in reversed(node.children) if isinstance(c, Node) and not c.hidden]
    size = select.attrs.get("size") or ""
    if "multiple" in select.attrs or size.isdigit() and int(size) > 1:
        return options
    chosen = [o for o in options if "selected" in o.attrs][-1:] or [o for o in options if "disabled" not in o.attrs][:1]
    return chosen


def _loose(node: Node) -> Iterator[Node | str]:
    """What stands in a table or its sections outside the rows."""
    for c in node.children:
        if isinstance(c, str):
            if c.strip():
                yield c
        elif c.tag in SECTIONS:
            if not c.hidden:
                yield from _loose(c)
        elif c.tag != "tr":
            yield c


def _rows(node: Node) -> Iterator[Node]:
    for c in node.children:
        if isinstance(c, Node) and not c.hidden:
            if c.tag == "tr":
                yield c
            elif c.tag in SECTIONS:
                yield from _rows(c)


def _span(cell: Node | str, name: str) -> int:
    value = "" if isinstance(cell, str) else cell.attrs.get(name) or ""
    if name == "rowspan" and value == "0":
        return MAX_SPAN[name]  # down to the last row
    return min(MAX_SPAN[name], max(1, int(value))) if value.isdigit() and len(value) < 10 else 1


def _width(text: str) -> int:
    return len(text) if text.isascii() else sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in text)


def _table(node: Node, page: Page, shown: bool) -> Step:
    """Cells rendered on their own and placed at their columns, which are as wide as their cells of one column, or wider
    at the end of a cell of several; what is not in a row comes before the rows."""
    rest = Node("div")
    rest.children = list(_loose(node))
    yield render(rest, page, False, shown)
    page.br()
    grid, below = [], {}  # below: rows that a column is still taken for
    for row in _rows(node):
        cells, at = [], 0
        seen = shown if row.visible is None else row.visible
        fresh = {}
        for c in row.children:
            if isinstance(c, str) and not c.strip() or isinstance(c, Node) and c.hidden:
                continue
            while below.get(at, 0):
                at += 1
            lines = ([_SPACE.sub(" ", c).strip()] if seen else [""]) if isinstance(c, str) else (yield _lines(c, seen if c.visible is None else c.visible))
            span = _span(c, "colspan")
            cells.append((at, span, lines))
            if _span(c, "rowspan") > 1:
                fresh |= dict.fromkeys(range(at, at + span), _span(c, "rowspan") - 1)
            at += span
        below = {i: n - 1 for i, n in below.items() if n > 1} | fresh
        grid.append(cells)
    widths = Counter()
    for cells in grid:
        for at, span, lines in cells:
            if span == 1:
                widths[at] = max(widths[at], *(min(MAX_COLUMN, _width(x)) for x in lines), 0)
    for cells in grid:
        for at, span, lines in cells:
            if span > 1:
                lack = min(MAX_COLUMN, max(map(_width, lines), default=0)) - sum(widths[i] + 2 for i in range(at, at + span)) + 2
                widths[at + span - 1] += max(0, lack)
    edge, left = [0], 0
    for i in range(max(widths, default=-1) + 1):
        left += widths[i] + 2
        edge.append(min(left, MAX_LEFT))
    for cells in grid:
        for i in range(max((len(lines) for _, _, lines in cells), default=0)):
            line, filled = "", 0
            for at, _, lines in cells:
                if i < len(lines) and lines[i]:
                    room = max(edge[min(at, len(edge) - 1)] - filled, 2 if line else 0)
                    line += " " * room + lines[i]
                    filled += room + _width(lines[i])
            page._put(line.rstrip() or " ")
            page.br()


def _lines(node: Node, shown: bool = True) -> Step:
    page = Page()
    yield render(node, page, False, shown)
    page.br()
    return page.lines


def visible_text(html: str) -> str:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return "\n".join(_run(_lines(builder.root))).strip("\n")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                texts = [visible_text(h) if h else "" for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["page_id", "text"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, text string")
