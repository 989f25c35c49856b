"""Layout-aware text of HTML pages.

A tree builder puts in the tags that pages leave out (ends of paragraphs, list items, table parts and
the head; rows of stray cells; stray table content goes in front of its table). The renderer leaves out what a
browser would not show and writes the rest as a page would look: blank lines between blocks,
bullets, numbers and indents of lists, preformatted text as it is, and table cells in aligned columns.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import strings, table


def names(text: str) -> frozenset[str]:
    return frozenset(text.split())


# Element classes of the HTML standard.
VOID = names("area base br col embed hr img input link meta param source track wbr")
RAW = names("script style textarea title xmp iframe noembed noframes noscript plaintext")
HEAD_ONLY = names("base basefont bgsound link meta noscript script style template title")
BLOCKS = names(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table ul"
)
ENDS_P = names(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr listing main menu nav ol p pre search section summary table ul li dd dt"
)
HEADINGS = names("h1 h2 h3 h4 h5 h6")
SPACED = names("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table blockquote pre listing hr figure fieldset xmp")
LISTS = names("ul ol menu dir")
HIDDEN = names("head script style template title iframe noembed noframes noscript object audio video canvas datalist rp svg math area base link meta param source track col colgroup embed")
CELLS = names("td th")
GROUPS = names("thead tbody tfoot")
TABLE_PARTS = names("caption colgroup col thead tbody tfoot tr td th")
WALLS = names("td th caption table html body template button object")

#: Elements below this depth become children of the element at it, as browsers do; no text is lost, and what they hide stays hidden.
MAX_DEPTH = 200
#: Limits of the HTML standard on spans.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534

_NAME = r"(?P<end{0}>/)?(?P<tag{0}>[a-zA-Z][^\s/>]*+)"
#: Comments; tags with closed quotes; tags with an open quote, up to the next ">"; other markup. What never ends takes the rest.
_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    rf"""|<{_NAME.format("")}(?P<rest>(?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>"""
    rf"|<{_NAME.format(2)}(?P<rest2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_HIDING = re.compile(r"(display\s*:\s*none)|visibility\s*:\s*(hidden|collapse|visible)")


class Node:
    __slots__ = ("tag", "attributes", "children", "depth", "parent")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.children, self.parent = tag, attributes, [], parent
        self.depth = parent.depth + 1 if parent else 0

    def attribute(self, name: str) -> str | None:
        """The first value of that name; an attribute without a value is empty."""
        if name in self.attributes.lower():
            for found in _ATTRIBUTE.finditer(self.attributes):
                if found[1].lower() == name:
                    return unescape(next((v for v in found.groups()[1:] if v is not None), ""))
        return None


class Tree:
    """Builds the tree while markup is read; ``open`` is the innermost open element, down to MAX_DEPTH.

    ``deep`` are the elements open below that, each with what its content is: (makes a box, visible; None: as around it).
    """

    def __init__(self):
        self.deep: list[tuple[Node, tuple[bool, bool | None]]] = []
        self.places: dict[str, list[int]] = {}  # where the elements of a name are in ``deep``
        self.root = self.open = Node("html", "", None)

    @property
    def open(self) -> Node:
        return self._open

    @open.setter
    def open(self, node: Node) -> None:
        self.leave(0)
        self._open = node

    def enter(self, node: Node) -> None:
        """Opens an element below the depth limit."""
        box, shown = self.deep[-1][1] if self.deep else (True, None)
        if node.tag == "summary" and self.deep and self.deep[-1][0].tag == "details":
            box, shown = self.deep[-2][1] if len(self.deep) > 1 else (True, None)
            box = box and visibility(self.deep[-1][0], shown)[0]
        own, shown = visibility(node, shown)
        folded = node.tag == "details" and node.attribute("open") is None
        self.places.setdefault(node.tag, []).append(len(self.deep))
        self.deep.append((node, (box and own and not folded, shown)))

    def leave(self, place: int) -> None:
        while len(self.deep) > place:
            self.places[self.deep.pop()[0].tag].pop()

    def nearest(self, tags: frozenset[str]) -> int:
        """Where the innermost of these is in ``deep``; -1 if it has none."""
        return max((self.places[tag][-1] for tag in tags if self.places.get(tag)), default=-1)

    def find(self, tags: frozenset[str], walls: frozenset[str]) -> Node | None:
        node = self.open
        while node.parent:
            if node.tag in tags:
                return node
            if node.tag in walls:
                return None
            node = node.parent
        return None

    def close(self, tags: frozenset[str], walls: frozenset[str]) -> None:
        if self.deep:
            place, wall = self.nearest(tags), self.nearest(walls)
            if place >= 0 and place >= wall:
                self.leave(place)
            if max(place, wall) >= 0:
                return
        if found := self.find(tags, walls):
            self.open = found.parent

    def attach(self, child: Node | str) -> None:
        """Below the open element; content that a table cannot hold goes in front of the table."""
        parent = self.open
        if self.deep:
            box, shown = self.deep[-1][1]
            if isinstance(child, Node) and child.tag == "summary" and self.deep[-1][0].tag == "details":
                box = True  # it has no children here; its content goes by its own state
            if not box:
                return
            if shown is not None:
                holder = Node("span", f'style="visibility:{"visible" if shown else "hidden"}"', parent)
                holder.children, child = [child], holder
        if parent.tag in TABLE_LEVELS and not (isinstance(child, str) and not child.strip()) and not (isinstance(child, Node) and child.tag in PARTS_OR_SILENT):
            holder = parent
            while holder.tag != "table" and holder.parent:
                holder = holder.parent
            if holder.parent:
                siblings = holder.parent.children
                siblings.insert(next(i for i in range(len(siblings) - 1, -1, -1) if siblings[i] is holder), child)
                return
        parent.children.append(child)

    def text(self, text: str) -> None:
        if self.open.tag == "head" and text.strip():
            self.open = self.open.parent
        self.attach(text)

    def start(self, tag: str, attributes: str) -> Node | None:
        if tag in ("html", "body", "frameset"):
            if self.open.tag == "head":
                self.open = self.open.parent
            return None
        if self.open.tag == "head" and tag not in HEAD_ONLY:
            self.open = self.open.parent
        if tag == "head" and self.open.parent:
            return None
        if tag in TABLE_PARTS and self.places.get("table"):
            pass  # parts of a table below the depth limit are elements like others
        elif tag in TABLE_PARTS:
            holder = self.find(names_table, frozenset())
            if not holder:
                return None  # no table is open: the tag means nothing
            if tag in CELLS:
                self.close(CELLS, names_table)
                if self.open.tag != "tr":
                    self.close(CAPTION_LIKE, names_table)
                    self.start("tr", "")
            elif tag == "tr":
                self.close(ROW, names_table)
                self.close(CAPTION_LIKE, names_table)
            elif tag != "col":
                self.close(GROUPS | CAPTION_LIKE, names_table)
                if self.open.tag != "table" and (row := self.find(ROW, names_table)):
                    self.open = row.parent
        elif tag in ENDS_P:
            if tag == "li":
                self.close(ITEM, LISTS | WALLS)
            elif tag in ("dt", "dd"):
                self.close(TERMS, DL | WALLS)
            self.close(P, WALLS)
            if tag in HEADINGS and (self.deep[-1][0] if self.deep else self.open).tag in HEADINGS:
                if self.deep:
                    self.leave(len(self.deep) - 1)
                else:
                    self.open = self.open.parent
        elif tag in ("option", "optgroup"):
            self.close(frozenset((tag, "option")), SELECT | WALLS)
        node = Node(tag, attributes, self.open)
        self.attach(node)
        if tag not in VOID:
            # the summary of details has to be its child or, as it, below the limit
            if not self.deep and self.open.depth < MAX_DEPTH - (tag == "details"):
                self.open = node
            else:
                self.enter(node)
        return node

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        elif tag in TABLE_PARTS or tag == "table":
            self.close(frozenset((tag,)), names_table if tag != "table" else frozenset())
        elif tag in HEADINGS:
            self.close(HEADINGS, WALLS)
        elif tag not in ("html", "body"):
            self.close(frozenset((tag,)), WALLS)


P, ITEM, TERMS, DL, SELECT, ROW = names("p"), names("li"), names("dt dd"), names("dl"), names("select"), names("tr")
names_table = names("table")
CAPTION_LIKE = names("caption colgroup")
TABLE_LEVELS = names("table thead tbody tfoot tr")
PARTS_OR_SILENT = TABLE_PARTS | names("script style template")


def parse(page: str) -> Node:
    tree, place, size = Tree(), 0, len(page)
    while place < size:
        mark = _MARKUP.search(page, place)
        if not mark:
            break
        if mark.start() > place:
            tree.text(unescape(page[place : mark.start()]))
        place = mark.end()
        if tag := mark["tag"] or mark["tag2"]:
            tag = tag.lower()
            if mark["end"] or mark["end2"]:
                tree.end(tag)
                continue
            node = tree.start(tag, mark["rest"] or mark["rest2"] or "")
            if tag in RAW and node is not None:
                stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, place) if tag != "plaintext" else None
                inner = page[place : stop.start() if stop else size]
                node.children.append(unescape(inner) if tag in ("textarea", "title") else inner)
                place = stop.start() if stop else size
                if tree.open is node:
                    tree.open = node.parent
                elif tree.deep and tree.deep[-1][0] is node:
                    tree.leave(len(tree.deep) - 1)
    if place < size:
        tree.text(unescape(page[place:]))
    return tree.root


def width(text: str) -> int:
    """Columns on a character grid; wide characters take two, combining marks none."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Lines of a block container; inline text gathers until a block or the end."""

    def __init__(self, pre: bool = False):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = 0
        self.pre = pre

    def add(self, lines: list[str], space: int = 0) -> None:
        """A block with ``space`` blank lines around it; of spaces that meet the larger counts."""
        self.flush()
        if lines:
            gap = max(self.gap, space)
            if self.lines:
                self.lines.extend([""] * gap)
            self.lines.extend(lines)
            self.gap = space

    def flush(self) -> None:
        text, self.inline = "".join(self.inline), []
        if self.pre:
            lines = text.expandtabs(8).removesuffix("\n").split("\n") if text.strip() else []
        else:
            lines = [_SPACE.sub(" ", line).strip(" ") for line in text.split("\n")]
            while lines and not lines[-1]:
                lines.pop()
            while lines and not lines[0]:
                lines.pop(0)
        if lines:
            if self.lines and self.gap:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            self.lines.extend(lines)


def number(node: Node, name: str, default: int, most: int = 10**9) -> int:
    value = (node.attribute(name) or "").strip()
    found = re.match(r"[+-]?[0-9]{1,12}", value)
    return max(-most, min(most, int(found[0]))) if found else default


def visibility(node: Node, shown: bool) -> tuple[bool, bool]:
    """(the element makes a box, its own text is visible)."""
    if node.tag in HIDDEN:
        return False, False
    if node.attributes:
        if node.attribute("hidden") is not None and (node.attribute("hidden") or "").lower() != "until-found-open":
            return False, False
        if style := node.attribute("style"):
            for none, value in _HIDING.findall(style.lower()):
                if none:
                    return False, False
                shown = value == "visible"
    if node.tag == "dialog" and node.attribute("open") is None:
        return False, False
    return True, shown


def walk(node: Node, flow: Flow, shown: bool, lists: int) -> None:
    closed = node.tag == "details" and node.attribute("open") is None
    for child in node.children:
        if isinstance(child, str):
            if shown and not closed:
                flow.inline.append(child if flow.pre else _SPACE.sub(" ", child))
            continue
        box, seen = visibility(child, shown)
        if not box or closed and child.tag != "summary":
            continue
        tag = child.tag
        if tag == "br":
            flow.inline.append("\n")
        elif tag == "hr":
            flow.add(["---"] if seen else [], 1)
        elif tag == "table":
            flow.add(render_table(child, seen), 1)
        elif tag in LISTS:
            flow.add(render_list(child, seen, lists), 0 if lists else 1)
        elif tag in ("pre", "listing", "xmp", "plaintext"):
            inner = Flow(pre=True)
            walk(child, inner, seen, lists)
            flow.add(finished(inner, drop_first=True), 1)
        elif tag in BLOCKS:
            inner = Flow(flow.pre)
            walk(child, inner, seen, lists)
            lines = finished(inner)
            if tag in ("blockquote", "dd"):
                lines = ["  " + line if line else line for line in lines]
            flow.add(lines, 1 if tag in SPACED else 0)
        elif tag == "input":
            if seen and (child.attribute("type") or "").lower() in ("submit", "button", "reset"):
                flow.inline.append(child.attribute("value") or "")
        else:
            walk(child, flow, seen, lists)
            if tag == "q" or tag in ("select", "button", "textarea"):
                flow.inline.append(" ")


def finished(flow: Flow, drop_first: bool = False) -> list[str]:
    flow.flush()
    if drop_first and flow.lines and not flow.lines[0]:
        flow.lines.pop(0)
    return flow.lines


def roman(n: int) -> str:
    out = ""
    for value, sign in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split()):
        out, n = out + sign * (n // value), n % value
    return out


def marker(style: str, n: int) -> str:
    if style in ("a", "A") and n > 0:
        letters = ""
        while n > 0:
            n, rest = divmod(n - 1, 26)
            letters = chr(97 + rest) + letters
        return letters if style == "a" else letters.upper()
    if style in ("i", "I") and 0 < n < 4000:
        return roman(n) if style == "i" else roman(n).upper()
    return str(n)


def render_list(node: Node, shown: bool, depth: int) -> list[str]:
    ordered, flow = node.tag == "ol", Flow()
    items = [c for c in node.children if isinstance(c, Node) and c.tag == "li" and visibility(c, shown)[0]]
    step = -1 if ordered and node.attribute("reversed") is not None else 1
    count = number(node, "start", len(items) if step < 0 else 1)
    style = (node.attribute("type") or "1") if ordered else ""
    for child in node.children:
        if isinstance(child, str):
            if shown:
                flow.inline.append(_SPACE.sub(" ", child))
            continue
        box, seen = visibility(child, shown)
        if not box:
            continue
        inner = Flow()
        if child.tag != "li":
            holder = Node("div", "", None)
            holder.children = [child]
            walk(holder, inner, shown, depth + 1)
            flow.add(["  " + line if line else line for line in finished(inner)])
            continue
        count = number(child, "value", count)
        walk(child, inner, seen, depth + 1)
        lines = finished(inner)
        sign = f"{marker(style, count)}. " if ordered else "* "
        if lines:
            flow.add([sign + lines[0], *(" " * len(sign) + line if line else line for line in lines[1:])])
        count += step
    return finished(flow)


def rows_of(node: Node, shown: bool) -> Iterator[tuple[int, Node, bool]]:
    """(order: head, body, foot; row; visible)"""
    for child in node.children:
        if isinstance(child, Node):
            box, seen = visibility(child, shown)
            if box and child.tag == "tr":
                yield {"thead": 0, "tfoot": 2}.get(node.tag, 1), child, seen
            elif box and child.tag in GROUPS:
                yield from rows_of(child, seen)


def render_table(node: Node, shown: bool) -> list[str]:
    head = Flow()
    for child in node.children:
        if isinstance(child, Node) and child.tag == "caption":
            box, seen = visibility(child, shown)
            if box:
                walk(child, head, seen, 0)
    grid: list[list[tuple[int, int, list[str]]]] = []
    taken: dict[int, int] = {}  # column → rows that a cell from above still takes
    for _, row, seen in sorted(rows_of(node, shown), key=lambda r: r[0]):
        cells, column, below = [], 0, {}
        for cell in row.children:
            if isinstance(cell, Node) and cell.tag in CELLS:
                box, visible = visibility(cell, seen)
                if not box:
                    continue
                while taken.get(column, 0):
                    column += 1
                span = max(1, number(cell, "colspan", 1, MAX_COLSPAN))
                deep = max(1, number(cell, "rowspan", 1, MAX_ROWSPAN))
                inner = Flow()
                walk(cell, inner, visible, 0)
                cells.append((column, span, finished(inner)))
                if deep > 1:
                    below.update({column + i: deep for i in range(span)})
                column += span
        grid.append(cells)
        taken = {c: n - 1 for c, n in (taken | below).items() if n > 1}
    widths: dict[int, int] = {}
    for cells in grid:
        for column, span, lines in cells:
            widths[column] = max(widths.get(column, 0), *(width(x) for x in lines), 0) if span == 1 and lines else widths.get(column, 0)
    starts, at = {}, 0
    for column in sorted(widths):
        starts[column] = at
        at += widths[column] + 2 if widths[column] else 0
    out = Flow()
    out.add(finished(head))
    for cells in grid:
        lines = []
        for i in range(max((len(x[2]) for x in cells), default=0)):
            line, used = "", 0
            for column, _, text in cells:
                if i < len(text) and text[i]:
                    pad = max(starts[column] - used, 2 if used else 0)
                    line += " " * pad + text[i]
                    used += pad + width(text[i])
            lines.append(line)
        out.add(lines)
    return finished(out)


def page_text(page: str) -> str:
    """All visible text of a page, laid out."""
    flow = Flow()
    walk(parse(page), flow, True, 0)
    return "\n".join(line.rstrip(" ") for line in finished(flow))


def html_text(df: DataFrame) -> DataFrame:
    """(page_id, text) for every row of (page_id, html).

    A null or empty page has the empty text. Rows are independent: repeated rows and null ids come
    back as they are; an empty table gives no rows; other columns are ignored. Pages of any length and any depth are
    read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [page_text(page) for page in strings(part.column("html"))]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(texts, pa.string())], ["page_id", "text"])

    return df.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, text string")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"))
