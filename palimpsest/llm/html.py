"""HTML extraction by layout: a tree builder with implied tags, visibility rules, and a renderer of all visible text.

Blocks stand on lines of their own, some with a blank line around; lists have marks and indents, tables aligned columns;
white space collapses but in ``pre``. The cells of a row that has one of several lines stand one below the other. Elements may
be nested as deep as they are. Indents and the padding of cells are bounded, so a rendered page grows in proportion to its
source.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Widest indent of a line, widest cell that the others of its column are aligned with, most columns or rows that a cell spans.
INDENT, WIDEST, SPAN = 80, 60, 100
#: Tables within so many others have their cells one below the other.
NESTED = 16

# Element classes of HTML.
VOID = "area base br col embed hr img input link meta source track wbr".split()
RAW = "script style textarea title noscript iframe template".split()
UNSEEN = "head script style title noscript iframe template datalist object audio video canvas".split()
BLOCKS = (
    "address article aside blockquote body center details dialog div dd dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption"
).split()
SPACED = "blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split()
# An open element that the start of another closes, and the ancestors at which the search ends.
CLOSES = {
    "li": (["li"], ["ul", "ol", "menu"]),
    "dt": (["dt", "dd"], ["dl"]),
    "dd": (["dt", "dd"], ["dl"]),
    "option": (["option"], ["select", "datalist"]),
    "td": (["td", "th"], ["tr", "table"]),
    "th": (["td", "th"], ["tr", "table"]),
    "tr": (["tr"], ["table"]),
    "tbody": (["tbody", "thead", "tfoot"], ["table"]),
    "thead": (["tbody", "thead", "tfoot"], ["table"]),
    "tfoot": (["tbody", "thead", "tfoot"], ["table"]),
}
_BLOCK, _VOID, _RAW, _UNSEEN, _SPACED = map(frozenset, (BLOCKS, VOID, RAW, UNSEEN, SPACED))
_CELLS = frozenset({"td", "th"})
_NOT_IN_P = frozenset(BLOCKS) - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend"}
# What begins a tag, or is markup without content: comments, declarations, end tags without a name.
_MARKUP = re.compile(r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|/[^A-Za-z>][^>]*+(?:>|\Z)|/>|(/?)([A-Za-z][^ \t\n\f\r/>]*+))", re.S)
# The states within a tag: before a name, after it, and an unquoted value. Slashes and stray quotes are no end of anything.
_NAME = re.compile(r"[ \t\n\f\r/]*+([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)?+")
_EQUALS = re.compile(r"[ \t\n\f\r]*+=[ \t\n\f\r]*+")
_BARE = re.compile(r"[^ \t\n\f\r>]*+")
_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
# What may stand in head, and what table, its sections and rows hold as structure.
IN_HEAD = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())
# and where SVG or MathML ends: at elements that hold HTML, and at tags that they can't contain.
HTML_WITHIN = "foreignobject desc annotation-xml".split()
BREAKS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
PARTS = frozenset("tr tbody thead tfoot colgroup col".split())
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    """An element: whether it is seen, columns and rows that it spans as a cell, whether a cell or row lies below it."""

    __slots__ = ("tag", "children", "seen", "span", "holds")

    def __init__(self, tag: str, seen: bool = True):
        self.tag, self.seen, self.span, self.holds = tag, seen, (1, 1), False
        self.children: list = []


def rest_of_tag(source: str, at: int) -> tuple[dict[str, str], bool, int] | None:
    """What follows a tag's name: its attributes, whether a slash stands before its end, and where it ends; None if the page
    ends first. Names are in lower case; of one name the first counts. A quote that the page never closes begins no quoted value.
    """
    out: dict[str, str] = {}
    while True:
        found = _NAME.match(source, at)
        at = found.end()
        if found[1] is None:
            return (out, found[0].endswith("/"), at + 1) if at < len(source) else None
        value, equals = "", _EQUALS.match(source, at)
        if equals:
            at = equals.end()
            quote = source[at : at + 1]
            end = source.find(quote, at + 1) if quote in ("'", '"') else -1
            if end >= 0:
                value, at = source[at + 1 : end], end + 1
            else:
                value = _BARE.match(source, at)[0]
                at += len(value)
        out.setdefault(found[1].lower(), html.unescape(value))


def hidden(tag: str, attributes: dict[str, str]) -> bool:
    """Whether the attributes hidden or style (or type, on input) take the element out of sight."""
    return "hidden" in attributes or bool(_STYLE.search(attributes.get("style", ""))) or (tag == "input" and attributes.get("type", "").strip().lower() == "hidden")


def _span(attributes: dict[str, str], name: str) -> int:
    value = attributes.get(name, "").strip()
    return min(max(int(value), 1), SPAN) if value.isascii() and value.isdigit() and len(value) < 10 else 1


class Tree:
    """The elements that are open, and where in the stack each kind is, so that the search for one takes no walk."""

    def __init__(self):
        self.stack = [Node("")]
        self.at: dict[str, list[int]] = {}

    def is_open(self, tag: str) -> bool:
        return bool(self.at.get(tag))

    def foreign(self) -> bool:
        """Whether a tag here is SVG's or MathML's, where a slash closes any element."""
        inside = max((self.at[x][-1] for x in ("svg", "math") if self.at.get(x)), default=0)
        return inside > max((self.at[x][-1] for x in HTML_WITHIN if self.at.get(x)), default=0)

    def add(self, child) -> None:
        self.stack[-1].children.append(child)

    def push(self, node: Node) -> None:
        self.add(node)
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def close(self, tags: list[str], ends: list[str]) -> None:
        """Close the innermost element of ``tags``, unless one of ``ends`` lies further in."""
        last = lambda names: max((self.at[x][-1] for x in names if self.at.get(x)), default=0)
        k = last(tags)
        if k and k >= last(ends):
            for node in self.stack[k:]:
                self.at[node.tag].pop()
            del self.stack[k:]


def parse(source: str) -> Node:
    tree = Tree()
    at = 0

    def string(text: str) -> None:
        if text.strip():
            tree.close(["head"], ["template"])
        tree.add(text)

    last = source.rfind(">")
    while at < len(source):
        found = _MARKUP.search(source, at) if at <= last or source.find("<!--", at) >= 0 else None
        if not found:
            string(source[at:])
            break
        if found.start() > at:
            string(source[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        tag, rest = found[2].lower(), rest_of_tag(source, at)
        if rest is None:  # what the page ends within is text
            string(source[found.start() :])
            break
        attributes, slash, at = rest
        if found[1]:
            if tag in _CELLS | PARTS | {"caption"}:
                ends = ["table"]
            else:  # what is open outside of a table is not closed from within
                ends = ["table"] if tag not in ("table", "html", "body") else []
            tree.close([tag], ends)
            continue
        if tag not in IN_HEAD:
            tree.close(["head"], [])
        if tag in CLOSES:
            tree.close(*CLOSES[tag])
        if tag in _NOT_IN_P:
            tree.close(["p"], ["td", "th", "table", "li", "div", "blockquote"])
        if tag in _CELLS and tree.stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            tree.push(Node("tr"))
        if tag in BREAKS and tree.foreign():
            tree.close(["svg", "math"], HTML_WITHIN)
        foreign = tree.foreign()
        node = Node(tag, tag not in _UNSEEN and not (attributes and hidden(tag, attributes)))
        if tag in _CELLS or tag in ("tr", "caption"):
            node.span = (_span(attributes, "colspan"), _span(attributes, "rowspan"))
            for above in reversed(tree.stack):
                if above.tag == "table" or above.holds:
                    break
                above.holds = True
        if tag in _VOID or (slash and (foreign or tag in ("svg", "math"))):
            tree.add(node)
        elif tag in _RAW and not foreign:
            tree.add(node)
            end = re.compile(f"</{tag}(?=[ \\t\\n\\f\\r/>])", re.I).search(source, at)
            node.children.append(source[at : end.start() if end else len(source)])
            after = rest_of_tag(source, end.end()) if end else None
            at = after[2] if after else len(source)
        else:
            tree.push(node)
    return tree.stack[0]


class Page:
    """Lines of text as they fill up."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.indent, self.mark, self.gap = "", "", False

    def text(self, text: str, keep: bool) -> None:
        text = html.unescape(text) if "&" in text else text
        if keep:
            first, *rest = text.split("\n")
            self.parts.append(first)
            for line in rest:
                self.newline(True)
                self.parts.append(line)
            return
        text = _SPACE.sub(" ", text)
        if not self.parts or self.parts[-1].endswith(" "):
            text = text.lstrip(" ")
        if text:
            self.parts.append(text)

    def newline(self, force: bool = False) -> None:
        line = "".join(self.parts).rstrip(" ")
        self.parts = []
        if line or force:
            if self.gap and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = False
            head = self.indent[: len(self.indent) - len(self.mark)] + self.mark if self.mark else self.indent
            self.lines.append((head + line).rstrip(" "))
            self.mark = ""


    def result(self) -> list[str]:
        """All lines, without empty ones at both ends."""
        self.newline()
        first = next((i for i, line in enumerate(self.lines) if line), len(self.lines))
        while len(self.lines) > first and not self.lines[-1]:
            self.lines.pop()
        return self.lines[first:]


# The functions below that walk the tree are generators: what they yield is run before they go on, by ``_run``. So the depth
# of a page takes no depth of calls.


def _run(walk) -> None:
    todo = [walk]
    while todo:
        below = next(todo[-1], None)
        if below is None:
            todo.pop()
        else:
            todo.append(below)


def _table(node: Node, page: Page, nested: int):
    """Rows of cells; what is neither structure nor cell stands before the table, as HTML's tree builder puts it."""
    rows: list[list[tuple[int, Node]]] = []
    outside: list = []
    busy: dict[int, int] = {}  # columns that cells of rows above still take, and for how many rows

    def begin() -> list[tuple[int, Node]]:
        for column in list(busy):
            busy[column] -= 1
            if busy[column] <= 0:
                del busy[column]
        rows.append([])
        return rows[-1]

    def place(row: list[tuple[int, Node]], cell: Node) -> None:
        column = row[-1][0] + row[-1][1].span[0] if row else 0
        while column in busy:
            column += 1
        row.append((column, cell))
        if cell.span[1] > 1:
            busy.update((column + k, cell.span[1]) for k in range(cell.span[0]))

    def cells(x: Node, row: list[tuple[int, Node]] | None):
        for child in x.children:
            if isinstance(child, str):
                outside.append(child)
                continue
            if not child.seen:
                continue
            inner = child.tag in PARTS or (child.tag not in ("td", "th", "caption", "table") and child.holds)
            if not inner and child.tag not in ("td", "th", "caption"):
                outside.append(child)
                continue
            outside.append(Node("div"))  # what stands on both sides is on lines of its own
            if child.tag in _CELLS:
                row = begin() if row is None else row
                place(row, child)
            elif child.tag == "caption":
                rows.append([(0, child)])
            elif child.tag == "tr":
                yield cells(child, begin())
            else:
                yield cells(child, row)
            outside.append(Node("div"))

    yield cells(node, None)
    if outside:
        around = Node("")
        around.children = outside
        yield _walk(around, page, False, nested)
        page.newline()
    if nested >= NESTED:
        for row in rows:
            for _, cell in row:
                page.newline()
                yield _walk(cell, page, False, nested)
                page.newline()
        return
    found: list[list[tuple[int, int, list[str]]]] = []
    for row in rows:
        found.append([])
        for column, cell in row:
            own = Page()
            yield _walk(cell, own, False, nested + 1)
            found[-1].append((column, cell.span[0], own.result()))
    _lay_out(found, page)


def _lay_out(rows: list[list[tuple[int, int, list[str]]]], page: Page) -> None:
    """Rows of (column, columns, lines) with aligned columns; a row with a cell of several lines has its cells one below the
    other. A cell that is wider than WIDEST is not waited for by others of its column."""
    widths: dict[int, int] = {}
    for row in rows:
        for column, columns, lines in row if len(row) > 1 else ():
            if columns == 1 and lines and len(lines) == 1 and len(lines[0]) <= WIDEST:
                widths[column] = max(widths.get(column, 0), len(lines[0]))
    starts, at = {}, 0
    for column in sorted(widths):
        starts[column] = at
        at += widths[column] + 2 if widths[column] else 0
    for row in rows:
        if any(len(lines) > 1 for _, _, lines in row):
            for _, _, lines in row:
                page.gap |= len(lines) > 1
                for line in lines:
                    page.parts = [line]
                    page.newline(True)
                page.gap |= len(lines) > 1
            continue
        line = ""
        for k, (column, _, lines) in enumerate(row):
            line = line.ljust(max(starts.get(column, 0), len(line) + 2 if k and line else 0))
            line += "".join(lines)
        page.parts = [line]
        page.newline()


def _walk(node: Node, page: Page, keep: bool, nested: int):
    number = 0
    for child in node.children:
        if isinstance(child, str):
            page.text(child, keep)
            continue
        tag = child.tag
        if not child.seen:
            continue
        if tag == "br":
            page.newline(True)
            continue
        if tag not in _BLOCK:
            if child.children:
                yield _walk(child, page, keep, nested)
            continue
        page.newline()
        spaced = tag in _SPACED and not (node.tag == "li" and tag in ("ul", "ol"))
        page.gap |= spaced and not page.mark
        if tag == "table":
            yield _table(child, page, nested)
        elif tag == "hr":
            page.parts = ["---"]
        elif tag == "li":
            number += 1
            was, mark = page.indent, f"{number}. " if node.tag == "ol" else "- "
            page.indent, page.mark = was[: INDENT - len(mark)] + " " * len(mark), mark
            yield _walk(child, page, keep, nested)
            page.newline()
            page.indent, page.mark = was, ""
        else:
            was = page.indent
            page.indent = (was + "  " * (tag in ("blockquote", "dd")))[:INDENT]
            yield _walk(child, page, keep or tag == "pre", nested)
            page.newline()
            page.indent = was
        page.newline()
        page.gap |= spaced and not page.mark


def render(node: Node) -> str:
    page = Page()
    _run(_walk(node, page, False, 0))
    return "\n".join(page.result())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars and n_lines of every row of (page_id, html); a null page gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(parse(x.as_py() or "")) for x in batch.column(1)]
            lines = [len(x.split("\n")) if x else 0 for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(lines, pa.int64())], ["page_id", "text", "n_chars", "n_lines"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, text string, n_chars long, n_lines long")
