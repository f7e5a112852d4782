"""Layout-aware text of HTML pages.

A tokenizer and a tree builder with implied tags (a new paragraph ends the open one, a list item the item before, a row its cells,
unknown end tags are ignored, what is open at the end is closed) read any input in linear time. The renderer walks the tree
without recursion: it leaves out what a reader doesn't see (head, scripts, styles, templates, comments, hidden and
display:none elements, closed alternatives such as noscript), collapses white space outside pre, sets blocks apart by line ends
and paragraphs by blank lines, marks list items by bullets or numbers, indented by depth, and aligns table cells by column,
column spans included. Images show their alternative text.

All visible text is kept: navigation, asides and footers too. One page is one row and one call; nothing is shuffled.

Defined cases: a null page has null text; an empty one, or one without visible text, an empty text; markup cut off in the middle
shows what stands before; repeated rows are rendered each; an empty table gives an empty one; other columns pass through, and one
named like the output is replaced.
"""
from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title meta link iframe object embed svg math canvas audio video datalist select option textarea".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCK = frozenset(
    "html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure article section nav header footer".split())
#: Elements that a start tag ends, and those that keep it from looking further up.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)), "thead": (("tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)), "body": (("head",), ("html",)),
}
P_ENDERS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol"
    " p pre section table ul".split()
)
SCOPES = frozenset("table td th caption button object html".split())
MARKUP = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)")
MARK = "• "
MAX_SPAN = 100


class Node:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: dict[str, str] | None = None):
        self.name, self.attributes, self.children = name, attributes or {}, []


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("#root")
    stack, at, end = [root], 0, len(page)
    open_count: dict[str, int] = {}

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            open_count[stack.pop().name] -= 1

    def last_open(names: tuple[str, ...], until: frozenset | tuple[str, ...]) -> int:
        """Depth of the outermost open element of `names` above the innermost one of `until`; 0 if there is none."""
        if not any(open_count.get(n) for n in names):
            return 0
        found = 0
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].name in until:
                break
            if stack[depth].name in names:
                found = depth
        return found

    def add_text(text: str) -> None:
        if text:
            stack[-1].children.append(html.unescape(text) if "&" in text else text)

    while at < end:
        hit = MARKUP.search(page, at)
        if hit is None:
            add_text(page[at:])
            break
        add_text(page[at : hit.start()])
        at = max(hit.end(), hit.start() + 1)
        closing, opening = hit.group(1), hit.group(2)
        if closing:
            name = closing.lower()
            if name == "br":
                stack[-1].children.append(Node("br"))
            elif name == "p" and not open_count.get("p"):
                stack[-1].children.append(Node("p"))
            elif open_count.get(name):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].name == name:
                        close_to(depth)
                        break
                    if stack[depth].name in SCOPES and name not in SCOPES and name not in ("table", "body", "tr", "tbody", "thead", "tfoot"):
                        break
        elif opening:
            name = opening.lower()
            raw = hit.group(3) or ""
            if name in P_ENDERS and (depth := last_open(("p",), SCOPES)):
                close_to(depth)
            if name in ENDS and (depth := last_open(*ENDS[name])):
                close_to(depth)
            node = Node(name, attributes(raw) if "=" in raw or "hidden" in raw.lower() else None)
            stack[-1].children.append(node)
            if name in VOID:
                continue
            if name in RAW:
                stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                node.children.append(page[at : stop.start() if stop else end])
                at = stop.end() if stop else end
                continue
            if not raw.rstrip().endswith("/") or name in BLOCK:
                stack.append(node)
                open_count[name] = open_count.get(name, 0) + 1
    return root


def visible(node: Node) -> bool:
    if node.name in HIDDEN:
        return False
    own = node.attributes
    return not own or not ("hidden" in own or own.get("aria-hidden", "").lower() == "true" or UNSEEN.search(own.get("style", "").lower()))


class Canvas:
    """Lines in the making: text joins the current line, gaps between blocks are remembered until text follows."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.space = False
        self.indent = ""
        self.mark = ""

    def break_line(self, gap: int = 0) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False
        self.gap = max(self.gap, gap)

    def write(self, text: str, kept: bool = False) -> None:
        if kept:
            first, *more = text.split("\n")
            self._put(first)
            for part in more:
                self.lines.append("".join(self.line).rstrip())
                self.line = [self.indent]
                self._put(part)
            return
        words = text.split()
        if not words:
            self.space = self.space or bool(text)
            return
        if self.line and (self.space or text[0].isspace()):
            self.line.append(" ")
        self.space = False
        self._put(" ".join(words))
        self.space = text[-1].isspace()

    def _put(self, text: str) -> None:
        if not self.line:
            if not text:
                return
            if self.lines and self.gap:
                self.lines.append("")
            self.gap = 0
            self.line.append(self.indent[: len(self.indent) - len(self.mark)] + self.mark if self.mark else self.indent)
            self.mark = ""
        self.line.append(text)

    def text(self) -> str:
        self.break_line()
        return "\n".join(self.lines).strip("\n")


def render(root: Node) -> str:
    """Visible text of a tree. Work is kept on an explicit stack: markup may be nested arbitrarily deep."""
    canvas = Canvas()
    todo: list[tuple] = [("open", root, False)]
    counters: list[int | None] = []
    tables: list[tuple[Canvas, list, list[Canvas]]] = []
    while todo:
        step, node, pre = todo.pop()
        if step == "text":
            canvas.write(node, pre)
        elif step == "close":
            canvas = _close(node, canvas, counters, tables)
        elif visible(node):
            name = node.name
            if name == "br":
                canvas.break_line() if canvas.line else canvas.lines.append("") if canvas.lines and not pre and canvas.lines[-1] else None
                continue
            if name == "hr":
                canvas.break_line(1)
                continue
            if name == "img":
                if node.attributes.get("alt", "").strip():
                    canvas.write(f" {node.attributes['alt']} ")
                continue
            canvas = _open(node, canvas, counters, tables)
            todo.append(("close", node, pre))
            inside = pre or name in ("pre", "listing", "xmp")
            todo.extend(("text" if isinstance(c, str) else "open", c, inside) for c in reversed(node.children))
    return canvas.text()


def _open(node: Node, canvas: Canvas, counters: list, tables: list) -> Canvas:
    name = node.name
    if name in ("td", "th") and tables:
        cell = Canvas()
        tables[-1][1].append((cell, _span(node)))
        tables[-1][2].append(canvas)
        return cell
    if name in BLOCK:
        canvas.break_line(int(name in SPACED and not counters))
    if name in ("ul", "ol", "menu", "dir"):
        start = node.attributes.get("start", "1")
        counters.append(int(start) - 1 if name == "ol" and re.fullmatch(r"-?\d{1,9}", start) else 0 if name == "ol" else None)
    elif name == "li":
        mark = MARK
        if counters and counters[-1] is not None:
            counters[-1] += 1
            mark = f"{counters[-1]}. "
        canvas.indent += " " * len(mark)
        canvas.mark = mark
        node.attributes = node.attributes | {"#indent": str(len(mark))}
    elif name in ("blockquote", "dd"):
        canvas.indent += "    "
    elif name == "table":
        tables.append((canvas, [], []))
        return Canvas()
    elif name == "tr" and tables:
        tables[-1][1].append(None)  # a row begins
    return canvas


def _close(node: Node, canvas: Canvas, counters: list, tables: list) -> Canvas:
    name = node.name
    if name in ("td", "th") and tables and tables[-1][2]:
        return tables[-1][2].pop()
    if name == "table" and tables:
        outer, cells, _ = tables.pop()
        loose = canvas.text()  # captions, and text beside the cells
        for block in (loose, grid(cells)):
            if block:
                outer.break_line()
                outer.write(block, True)
                outer.break_line(1)
        return outer
    if name in BLOCK:
        canvas.break_line(int(name in SPACED and len(counters) <= (name in ("ul", "ol", "menu", "dir"))))
    if name in ("ul", "ol", "menu", "dir") and counters:
        counters.pop()
    elif name == "li":
        canvas.indent = canvas.indent[: len(canvas.indent) - int(node.attributes["#indent"])]
        canvas.mark = ""
    elif name in ("blockquote", "dd"):
        canvas.indent = canvas.indent[:-4]
    return canvas


def _span(node: Node) -> int:
    raw = node.attributes.get("colspan", "1").strip()
    return min(max(1, int(raw)), MAX_SPAN) if re.fullmatch(r"\d{1,9}", raw) else 1


def width(text: str) -> int:
    """Columns on a terminal: wide characters take two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def grid(cells: list) -> str:
    """Rows of cells (None begins a row) with columns aligned; a cell of several lines takes several lines."""
    rows: list[list[tuple[list[str], int]]] = [[]]
    for cell in cells:
        if cell is None:
            rows.append([])
        else:
            rows[-1].append((cell[0].text().split("\n"), cell[1]))
    rows = [r for r in rows if r]
    wide: list[int] = []
    for row in rows:
        at = 0
        for lines, span in row:
            wide += [0] * (at + span - len(wide))
            if span == 1:
                wide[at] = max(wide[at], max(map(width, lines)))
            at += span
    for row in rows:  # a span widens its last column
        at = 0
        for lines, span in row:
            lack = max(map(width, lines)) - sum(wide[at : at + span]) - 2 * (span - 1)
            if span > 1 and lack > 0:
                wide[at + span - 1] += lack
            at += span
    out = []
    for row in rows:
        for i in range(max(len(lines) for lines, _ in row)):
            at, parts = 0, []
            for lines, span in row:
                own = lines[i] if i < len(lines) else ""
                parts.append(own + " " * (sum(wide[at : at + span]) + 2 * (span - 1) - width(own)))
                at += span
            out.append("  ".join(parts).rstrip())
    return "\n".join(out).strip("\n")


def text_of(page: str | None) -> str | None:
    return None if page is None else render(parse(page.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "")))


def extract(pages: DataFrame, source: str = "html", out: str = "text") -> DataFrame:
    """Replace the markup in `source` by its visible text in `out`."""
    kept = [f for f in pages.schema.fields if f.name not in (source, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [text_of(x.as_py()) for x in part.column(source)]
                yield pa.RecordBatch.from_pydict({f.name: part.column(f.name) for f in kept} | {out: pa.array(found, pa.string())})

    return pages.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.StringType())]))
