"""HTML extraction by layout-aware rendering.

A page is read into a tree, with the end tags and containers that HTML lets authors leave out; then the tree is laid out as
text: blocks on lines of their own, a blank line around paragraphs, lists with markers and indent, tables with aligned
columns, preformatted text as it is. All visible text is kept, in order; what a browser hides is left out.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.common import table

# Element names by role, as the HTML standard has them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
HEAD = frozenset("base basefont bgsound link meta title style script template noscript".split())
HIDDEN = frozenset("head script style template noscript title datalist noembed noframes iframe area base link meta param".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "ul xmp".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir fieldset xmp".split())
ENDS_P = BLOCKS - frozenset("body html option optgroup legend li dt dd".split()) | {"li", "dt", "dd"}
LISTS = frozenset("ul ol menu dir".split())
# A start tag ends open elements of the second set, up to the nearest of the third.
IMPLIED_ENDS = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
TABLE_PARTS = frozenset("table tr tbody thead tfoot td th".split())
SAID = frozenset("hidden collapse visible".split())
SCOPES = frozenset({"table", "td", "th", "caption", "template", "button"})
SPACES = " \t\n\r\f"

# Quotes count right after an equals sign alone; one that is never closed is a character like any other. A tag that the page
# ends in is a tag.
TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<!\[CDATA\[|<[!?][^>]*+>|</([a-zA-Z][^\s/>]*+)[^>]*+>"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z]+)", re.I)
DEEPEST_TABLE = 30  # tables within more tables than that are laid out as blocks
SPARE_WIDTH = 16  # a cell much wider than the others of its column (twice the median and this) does not widen them


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def parse(page: str) -> Node:
    """The tree of a page. Text is a str child; unknown and unmatched end tags are passed over."""
    root = Node("html", {})
    stack = [root]
    places: dict[str, list[int]] = {}  # where elements of a name are open in the stack

    def push(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def cut(k: int) -> None:
        for node in stack[k:]:
            places[node.tag].pop()
        del stack[k:]

    def innermost(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(ended: set[str], bounds) -> None:
        while (k := innermost(ended)) > innermost(bounds):
            cut(k)

    def add_text(text: str) -> None:
        if text:
            if stack[-1].tag == "head" and text.strip():
                cut(len(stack) - 1)
            stack[-1].children.append(text)

    at, sections = 0, True
    while True:
        found = TOKEN.search(page, at)
        add_text(entities.unescape(page[at : found.start() if found else len(page)]))
        if not found:
            return root
        at = found.end()
        ended, started = found[1], found[2]
        if ended:
            ended = ended.lower()
            if ended == "br":
                stack[-1].children.append(Node("br", {}))
            elif ended not in ("html", "body"):
                k = innermost([ended])
                if k and (ended in TABLE_PARTS or k >= innermost(SCOPES)):
                    cut(k)
            continue
        if not started:
            if found[0] == "<![CDATA[":
                end = page.find("]]>", at) if sections else -1
                sections = end >= 0
                if end >= 0:
                    add_text(page[at:end])
                    at = end + 3
            continue
        tag = started.lower()
        if tag in ("html", "body"):
            close({"head"}, ())
            continue
        if stack[-1].tag == "head" and tag not in HEAD:
            cut(len(stack) - 1)
        if tag in ENDS_P:
            close({"p"}, SCOPES)
        if tag in IMPLIED_ENDS:
            close(*IMPLIED_ENDS[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr", {})
            stack[-1].children.append(row)
            push(row)
        text = found[3]
        attrs = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text else {}
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
            inner = page[at : end.start() if end else len(page)]
            if tag in ("textarea", "title"):
                inner = entities.unescape(inner)
            node.children.append(inner)
            at = len(page) if not end else page.find(">", end.start()) + 1 or len(page)
        elif tag not in VOID and not (text.endswith("/") and tag in ("svg", "path")):
            push(node)


def visible(node: Node) -> bool:
    if node.tag in HIDDEN or "hidden" in node.attrs:
        return False
    if node.tag == "dialog" and "open" not in node.attrs:
        return False
    return not ("style" in node.attrs and NO_DISPLAY.search(node.attrs["style"]))


def concealed(node: Node, inherited: bool) -> bool:
    """Whether the text of an element keeps its place unseen; a child may be visible again."""
    said = VISIBILITY.findall(node.attrs.get("style", ""))
    return said[-1].lower() in ("hidden", "collapse") if said and said[-1].lower() in SAID else inherited


class Lines:
    """Text laid out in lines."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.space = 0, False
        self.indents, self.marker = [""], None

    def begin(self) -> None:
        if self.gap == 2 and self.lines:
            self.lines.append("")
        self.gap = 0
        self.line.append(self.indents[-1] if self.marker is None else self.marker)
        self.marker = None

    def text(self, text: str) -> None:
        body = " ".join(x for x in re.split(f"[{SPACES}]+", text) if x).replace("\xa0", " ")
        if not body:
            self.space = self.space or bool(self.line)
            return
        if not self.line:
            self.begin()
        elif self.space or text[0] in SPACES:
            self.line.append(" ")
        self.line.append(body)
        self.space = text[-1] in SPACES

    def ready(self, rows: list[str]) -> None:
        """Lines that are laid out already."""
        for row in rows:
            if not self.line:
                self.begin()
            self.line.append(row)
            self.end(1)

    def end(self, gap: int) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.gap, self.space = max(self.gap, gap), False


def _marker(node: Node, parent: Node | None, numbers: dict[int, int]) -> str:
    if parent is None or parent.tag != "ol":
        return "- "
    start = parent.attrs.get("start", "1").strip()
    number = numbers.get(id(parent), int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1)
    own = node.attrs.get("value", "").strip()
    number = int(own) if re.fullmatch(r"-?\d{1,9}", own) else number
    numbers[id(parent)] = number + 1
    return f"{number}. "


def lay_out(top: Node, depth: int = 0, unseen: bool = False) -> list[str]:
    out, numbers = Lines(), {}
    # (node, parent, leaving?, is the parent's text unseen?); a stack, as pages nest as deep as they like.
    todo: list[tuple[object, Node | None, bool, bool]] = [(c, top, False, unseen) for c in reversed(top.children)]
    pre = 1 if top.tag in ("pre", "xmp") else 0
    while todo:
        node, parent, leaving, unseen = todo.pop()
        closed = parent is not None and parent.tag == "details" and "open" not in parent.attrs
        if isinstance(node, str):
            if closed or unseen:
                continue
            if pre:
                rows = node.replace("\r\n", "\n").split("\n")
                for k, row in enumerate(rows):
                    if k:
                        if not out.line:
                            out.begin()
                        out.end(1)
                    if row:
                        if not out.line:
                            out.begin()
                        out.line.append(row)
            else:
                out.text(node)
            continue
        tag = node.tag
        gap = 2 if tag in SPACED else 1
        if tag in LISTS and any(p.tag == "li" for p in (parent,) if p is not None):
            gap = 1
        if leaving:
            if tag in ("pre", "xmp"):
                pre -= 1
            if tag in BLOCKS:
                out.end(gap)
            if tag in ("li", "dd", "blockquote"):
                out.indents.pop()
                out.marker = None
            continue
        if not visible(node):
            continue
        unseen = concealed(node, unseen)
        if closed and tag != "summary":
            continue
        if tag == "br":
            if not out.line and out.lines and not out.gap:
                out.begin()
            elif not out.line and out.gap == 1 and out.lines:
                out.lines.append("")
            out.end(1)
            continue
        if tag in ("td", "th", "tr", "caption"):  # outside of a table that is laid out
            out.end(1)
        if tag in BLOCKS:
            out.end(gap)
        if tag == "table" and depth < DEEPEST_TABLE:
            out.ready(table_lines(node, depth + 1, unseen))
            out.end(2)
            continue
        if tag == "li":
            out.marker = out.indents[-1] + _marker(node, parent, numbers)
            out.indents.append(out.indents[-1] + "  ")
        elif tag in ("dd", "blockquote"):
            out.indents.append(out.indents[-1] + "  ")
        elif tag in ("pre", "xmp"):
            pre += 1
            if node.children and isinstance(node.children[0], str) and node.children[0].startswith("\n"):
                node.children[0] = node.children[0][1:]
        todo.append((node, parent, True, unseen))
        todo += [(c, node, False, unseen) for c in reversed(node.children)]
    out.end(0)
    return out.lines


def _aligned(lengths: list[int]) -> int:
    """Width of a column: that of its widest line, but for lines far wider than most."""
    most = 2 * sorted(lengths)[len(lengths) // 2] + SPARE_WIDTH
    return max((n for n in lengths if n <= most), default=0)


def table_lines(node: Node, depth: int, unseen: bool = False) -> list[str]:
    """Caption and other stray text first, then the rows with their columns aligned."""
    stray, rows = Node("div", {}), []
    todo = [(c, unseen) for c in reversed(node.children)]
    while todo:
        child, hidden = todo.pop()
        if isinstance(child, str):
            if not hidden:
                stray.children.append(child)
            continue
        if not visible(child) or child.tag in ("colgroup", "col"):
            continue
        hidden = concealed(child, hidden)
        if child.tag in ("thead", "tbody", "tfoot", "form"):
            todo += [(c, hidden) for c in reversed(child.children)]
        elif child.tag == "tr":
            rows.append([(c, concealed(c, hidden)) for c in child.children if not isinstance(c, str) and visible(c)])
            if not hidden:
                stray.children += [c for c in child.children if isinstance(c, str) and c.strip()]
        elif child.tag == "caption":
            stray.children.append(Node("div", child.attrs))
            stray.children[-1].children = child.children
        else:
            stray.children.append(child)
    grid = []
    for cells in rows:
        placed, column = [], 0
        for cell, hidden in cells:
            span = cell.attrs.get("colspan", "1").strip()
            width = min(1000, max(1, int(span))) if re.fullmatch(r"\d{1,9}", span) else 1
            placed.append((column, width, lay_out(cell, depth, hidden)))
            column += width
        if any(lines for _, _, lines in placed):
            grid.append(placed)
    lengths: dict[int, list[int]] = {}
    for placed in grid:
        for column, width, lines in placed:
            if width == 1:
                lengths.setdefault(column, []).append(max(map(len, lines), default=0))
    widths = {column: _aligned(found) for column, found in lengths.items()}
    out = lay_out(stray, depth, unseen) if stray.children else []
    for placed in grid:
        for k in range(max(len(lines) for _, _, lines in placed)):
            parts = []
            for column, width, lines in placed:
                room = sum(widths.get(c, 0) for c in range(column, column + width)) + 2 * (width - 1)
                parts.append((lines[k] if k < len(lines) else "").ljust(room))
            out.append("  ".join(parts).rstrip())
    return out


def page_text(page: str | None) -> str:
    return "\n".join(lay_out(parse(page))) if page else ""


def rendered() -> Column:
    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pd.Series([page_text(p) for p in pages], dtype=object)

    return of(F.col("html"))


def extracted(pages: DataFrame) -> DataFrame:
    """pages with the column `text`: all visible text of `html`, laid out; other columns and all rows stay.

    Null and empty html give an empty text. A column `text` that is there already is replaced.
    """
    return pages.withColumn("text", rendered())


def op9_page_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extracted(table(spark, sf_dir, "pages").select("page_id", "html"))
    return rows.select("page_id", "text", F.char_length("text").cast("long").alias("n_chars"))
