"""Visible text of HTML pages: a tree builder with implied tags, visibility rules and a layout renderer."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEAD = frozenset("title meta link base script style noscript template basefont bgsound noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes datalist object audio video canvas desc metadata annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt".split())
#: An opening tag closes these open elements, looking up as far as the scopes.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr"}, {"table", "thead", "tbody", "tfoot"}),
    "tbody": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: A closing tag does not reach out of these, but for the parts of a table; a <p> does not end beyond these and _HOLDS_P.
BARRIER = frozenset("td th table caption button".split())
_REACHES = frozenset("table tr tbody thead tfoot body html td th".split())
_HOLDS_P = BARRIER | frozenset("div section article li blockquote body".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)", re.S)
#: The rest of a tag, and its rest where quotes do not match.
_QUOTED, _PLAIN = re.compile(r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S), re.compile(r"([^>]*)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
#: Columns or rows that a cell may span.
MAX_SPAN = 1000
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class _Open:
    """The open elements, with the places of each tag, so that no rule walks them."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}

    @property
    def top(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tags: Iterable[str]) -> int:
        """Place of the innermost of these, or 0."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def cut(self, place: int) -> None:
        """Closes all from this place on."""
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()

    def close(self, tags: Iterable[str], scope: Iterable[str]) -> None:
        """Closes these elements as far as the innermost of the scopes."""
        bound, first = self.last(scope), len(self.nodes)
        for t in tags:
            own = self.places.get(t, [])
            i = bisect_right(own, bound)
            first = min(first, own[i]) if i < len(own) else first
        self.cut(first)


def build(page: str) -> Node:
    """The tree of a page in time in proportion to its length; malformed nesting never fails, whatever is still open ends with the page.

    A tag that never ends is text, with all behind it. Where a quote never ends, quotes in tags mean nothing from there on.
    """
    root = Node("#root", {})
    stack, at, n = _Open(root), 0, len(page)
    tail = _QUOTED
    ends: dict[str, re.Pattern] = {}

    def text(a: int, b: int) -> None:
        if b > a:
            if stack.top.tag == "head" and not page[a:b].isspace():
                stack.cut(len(stack.nodes) - 1)
            stack.top.children.append(entities.unescape(page[a:b]))

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            break
        rest = None
        if m[2]:
            rest = tail.match(page, m.end())
            if not rest:
                tail = _PLAIN
                rest = tail.match(page, m.end())
                if not rest:
                    break
        text(at, m.start())
        at = rest.end() if rest else m.end()
        if not rest:
            continue
        tag, attrs = m[2].lower(), rest[1]
        if m[1]:
            if tag == "br":
                stack.top.children.append(Node("br", {}))
            else:
                place = stack.last((tag,))
                if place and (tag in _REACHES or place >= stack.last(BARRIER)):
                    stack.cut(place)
            continue
        if stack.top.tag == "head" and tag not in HEAD:
            stack.cut(len(stack.nodes) - 1)
        if tag in CLOSES_P:
            place = stack.last(("p",))
            if place > stack.last(_HOLDS_P):
                stack.cut(place)
        if tag in IMPLIED:
            stack.close(*IMPLIED[tag])
        if tag in ("td", "th") and stack.top.tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr", {})
            stack.top.children.append(row)
            stack.push(row)
        node = Node(tag, {k.lower(): entities.unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(attrs)} if attrs.strip() else {})
        stack.top.children.append(node)
        if tag in RAW:
            end = ends.setdefault(tag, re.compile(rf"</{re.escape(tag)}\s*/?>", re.I)).search(page, at)
            b = end.start() if end else n
            if b > at:
                node.children.append(entities.unescape(page[at:b]) if tag in ("textarea", "title") else page[at:b])
            at = end.end() if end else n
        elif tag not in VOID and not attrs.rstrip().endswith("/"):
            stack.push(node)
    text(at, n)
    return root


def visible(node: Node) -> bool:
    a = node.attrs
    return node.tag not in HIDDEN and "hidden" not in a and not _NONE.search(a.get("style", "")) and not (node.tag == "dialog" and "open" not in a)


class _Out:
    """Text under construction: runs of white space collapse, block breaks collect."""

    def __init__(self):
        self.parts: list[str] = []
        self.breaks, self.space, self.some = 0, False, False

    def text(self, s: str, pre: bool) -> None:
        if pre:
            if s:
                self._start()
                self.parts.append(s.replace("\r\n", "\n"))
            return
        words = _SPACE.sub(" ", s)
        if words.startswith(" "):
            self.space = True
            words = words[1:]
        if not words:
            return
        tail = words.endswith(" ")
        self._start()
        self.parts.append(words[:-1] if tail else words)
        self.space = tail

    def _start(self) -> None:
        if self.some:
            self.parts.append("\n" * self.breaks or " " * self.space)
        self.some, self.breaks, self.space = True, 0, False

    def mark(self, s: str) -> None:
        self._start()
        self.parts.append(s)
        self.space = False

    def line(self, n: int) -> None:
        self.breaks, self.space = max(self.breaks, n), False

    def value(self) -> str:
        return "".join(self.parts)


def _span(node: Node, name: str) -> int:
    n = node.attrs.get(name, "").strip()
    return max(1, min(int(n), MAX_SPAN)) if n.isascii() and n.isdigit() and len(n) < 6 else 1


#: One cell: text, columns and rows it spans.
Cell = tuple[str, int, int]


def _table(rows: list[list[Cell]]) -> str:
    """Rows with aligned cells, parted by " | "; a cell keeps its lines, and one that spans columns or rows their places."""
    placed: list[dict[int, tuple[list[str], int]]] = [{} for _ in rows]
    taken: list[set[int]] = [set() for _ in rows]
    for i, row in enumerate(rows):
        at = 0
        for text, columns, down in row:
            while at in taken[i]:
                at += 1
            lines = text.strip("\n").split("\n")
            # A tall cell stands in its first row and holds its columns in the others.
            for k in range(i, min(i + down, len(rows))):
                taken[k].update(range(at, at + columns))
            placed[i][at] = (lines, columns)
            at += columns
    used = sorted({c for row in placed for c in row})
    if not used:
        return ""
    number = {c: k for k, c in enumerate(used)}
    widths = [0] * len(used)
    # Columns in which no cell begins have no width; a cell's columns end where the next used one begins.
    cells = [{number[c]: (lines, max(1, sum(c <= u < c + span for u in used))) for c, (lines, span) in row.items()} for row in placed]
    for wide in sorted({s for row in cells for _, s in row.values()}):
        for row in cells:
            for c, (lines, s) in row.items():
                if s == wide:
                    have = sum(widths[c : c + s]) + 3 * (s - 1)
                    widths[c + s - 1] += max(0, max(map(len, lines)) - have)
    out = []
    for row in cells:
        for k in range(max((len(lines) for lines, _ in row.values()), default=0)):
            line, c = [], 0
            while c < len(used):
                lines, s = row.get(c, ([], 1))
                line.append((lines[k] if k < len(lines) else "").ljust(sum(widths[c : c + s]) + 3 * (s - 1)))
                c += s
            while line and not line[-1].strip():
                line.pop()
            out.append(" | ".join(line).rstrip())
    return "\n".join(out)


def render(root: Node) -> str:
    """All visible text: blocks on lines of their own, blank lines around paragraphs and lists, list marks, aligned tables."""
    out, outer = _Out(), []
    lists: list[list] = []
    tables: list[list[list[Cell]]] = []
    pre = 0
    todo: list[tuple[str, object]] = [("in", root)]
    while todo:
        what, x = todo.pop()
        if what == "out":
            tag = x.tag
            if tag in ("td", "th") and tables:
                cell, out = out.value(), outer.pop()
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append((cell, _span(x, "colspan"), _span(x, "rowspan")))
            elif tag == "table":
                rows = [r for r in tables.pop() if r]
                if any(cell.strip() for r in rows for cell, _, _ in r):
                    out.line(2)
                    out.mark(_table(rows))
                out.line(2)
            elif tag in BLOCK and tag != "tr":
                out.line(2 if tag in SPACED and not (tag in ("ul", "ol") and len(lists) > 1) else 1)
                if tag in ("ul", "ol", "menu", "dir"):
                    lists.pop()
                elif tag == "blockquote":
                    pass
            if tag == "pre":
                pre -= 1
            continue
        if isinstance(x, str):
            out.text(x, pre > 0)
            continue
        tag = x.tag
        if tag == "br":
            out.breaks, out.space = out.breaks + 1, False
            continue
        if not visible(x):
            continue
        if tag == "img":
            out.text(x.attrs.get("alt", ""), False)
            continue
        if tag == "input":
            if x.attrs.get("type", "text").lower() in ("submit", "button", "reset"):
                out.text(x.attrs.get("value", ""), False)
            continue
        if tag in ("td", "th") and tables:
            outer.append(out)
            out = _Out()
        elif tag == "table":
            tables.append([])
        elif tag == "tr" and tables:
            tables[-1].append([])
        elif tag in BLOCK:
            out.line(2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1)
            if tag in ("ul", "ol", "menu", "dir"):
                start = x.attrs.get("start", "1")
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                own = lists[-1] if lists else [False, 1]
                out.mark("  " * max(0, len(lists) - 1) + (f"{own[1]}. " if own[0] else "- "))
                own[1] += 1
        if tag == "pre":
            pre += 1
        todo.append(("out", x))
        todo += [("in", c) for c in reversed(x.children)]
    return out.value().strip("\n")


def page_text(page: str | None) -> str:
    return render(build(page or ""))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [page_text(x.as_py()) for x in batch.column("_html")]
        names = [n for n in batch.schema.names if n != "_html"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, "visible_text"])


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without html_col, with `visible_text string`.

    Shown are the texts of all elements but HIDDEN ones and those whose attributes hide them, form fields and drawings
    included. Cells keep their lines. Time grows with the page's length, whatever its tags are. Null and empty pages give an empty text; plain text gives itself with white space collapsed; a column
    that is already named visible_text is replaced; repeated rows stay; no rows give no rows.
    """
    own = [c for c in pages.columns if c not in (html_col, "visible_text", "_html")]
    rows = pages.select(*own, F.col(html_col).cast("string").alias("_html"))
    schema = T.StructType([*(rows.schema[c] for c in own), T.StructField("visible_text", T.StringType())])
    return rows.mapInArrow(_extract, schema)
