"""Text of web pages as a text browser lays it out.

A page is cut into tokens, and these are built into a tree with the implied tags of the
HTML standard: paragraphs, list items, cells and the like end where the next one begins,
a misnested inline end tag leaves the blocks open, and what stands between the cells of a
table moves before it.  The tree is then rendered: invisible elements are left out, white
space collapses outside preformatted text, blocks begin on lines of their own, list items
carry bullets or numbers, and the cells of a table stand in columns.

Visible is what neither its element, the ``hidden`` attribute, its style nor a plain rule
(tag, class, id) of the page's style sheets hides; rules inside @-blocks are not read.
Images, form values and link targets give no text.  Below ``DEPTH`` open elements new ones
become siblings; columns are padded up to ``COLUMN`` characters and lines indented up to
``INDENT``, so the text stays in proportion to the page, but none of it is dropped.

One row comes back per row given; null html gives null text and title.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from waybill.llm.common import table
from waybill.llm.words import slices

DEPTH = 512
COLUMN = 80
WIDTH = 400
INDENT = 40
COLUMNS = 1000


def _names(text: str) -> frozenset[str]:
    return frozenset(text.split())


VOID = _names("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr")
RAW = _names("script style xmp iframe noembed noframes")
# Raw text whose character references count.
ESCAPED = _names("title textarea")
HIDDEN = _names(
    "area audio base basefont canvas datalist embed frame head iframe input link meta noembed noframes object param "
    "rp script source style template title track video"
)
SPACED = _names("blockquote dir dl fieldset figure h1 h2 h3 h4 h5 h6 hr listing menu ol p plaintext pre table ul xmp")
BLOCKS = SPACED | _names(
    "address article aside body caption center dd details dialog div dt figcaption footer form frameset header hgroup "
    "legend li main nav optgroup option search section summary tbody td tfoot th thead tr"
)
CLOSES_P = BLOCKS - _names("body caption frameset legend optgroup option tbody td tfoot th thead tr")
SECTIONS = _names("tbody thead tfoot")
IN_TABLE = SECTIONS | _names("table tr")
CELLS = _names("td th")
TABLE_PARTS = SECTIONS | CELLS | _names("tr caption colgroup col")
HEADINGS = _names("h1 h2 h3 h4 h5 h6")
# An end tag or an implied end does not reach beyond these.
WALLS = _names("applet button caption marquee object table td template th")
SPECIAL = BLOCKS | WALLS | _names("select textarea title style script")
FORMATS = _names("a b big code em font i nobr s small strike strong tt u")
PREFORMATTED = _names("listing plaintext pre textarea xmp")
LISTS = _names("dir menu ol ul")
UNSEEN = _names("script style template")

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:>|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|(?!["'])([^\s>]*)))?)""")
_QUOTE = re.compile(r"\s*=\s*[\"']")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW | ESCAPED}
_COMMENT_END = re.compile(r"--!?>")
_SPACE = " \t\n\r\f"
_SPACES = re.compile(r"[ \t\n\r\f]+")
_RULE = re.compile(r"([a-z][a-z0-9-]*|\*)?((?:[.#][\w-]+)*)", re.I)
_INTEGER = re.compile(r"\s*([+-]?\d{1,9})")


class Node:
    """An element, or with name "" a text."""

    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: dict | None = None, children=None):
        self.name = name
        self.attributes = attributes or {}
        self.children = [] if children is None else children


# -- tokens ----------------------------------------------------------------------------

def tokens(html: str) -> Iterator[tuple]:
    """("text", text), ("start", name, attributes, closed) and ("end", name), in order."""
    at, size = 0, len(html)
    while at < size:
        begin = html.find("<", at)
        begin = size if begin < 0 else begin
        if begin > at:
            text = html[at:begin]
            yield "text", unescape(text) if "&" in text else text
        if begin == size:
            return
        found = _TAG.match(html, begin)
        if found is None:
            follows = html[begin + 1 : begin + 2]
            if html.startswith("<!--", begin):
                if html.startswith((">", "->"), begin + 4):  # an empty comment
                    at = html.index(">", begin) + 1
                    continue
                end = _COMMENT_END.search(html, begin + 4)
                at = end.end() if end else size
            elif follows in ("!", "?", "/") and follows:
                end = html.find(">", begin)
                if follows == "/" and begin + 2 == size:
                    yield "text", "</"
                at = end + 1 if end >= 0 else size
            else:
                yield "text", "<"
                at = begin + 1
            continue
        name, at, attributes = found[2].lower(), found.end(), {}
        while True:
            part = _ATTRIBUTE.match(html, at)
            if part is None:  # the page ends inside the tag
                return
            at = part.end()
            if part[1] is None:
                break
            value = next((g for g in part.groups()[1:] if g is not None), "")
            # A quote that is never closed takes the rest of the page.
            if part.lastindex == 1 and (opened := _QUOTE.match(html, at)):
                if html.find(html[opened.end() - 1], opened.end()) < 0:
                    return
            attributes.setdefault(part[1].lower(), unescape(value) if "&" in value else value)
        if found[1]:
            yield "end", name
            continue
        yield "start", name, attributes, html[at - 2] == "/"
        if name == "plaintext":
            yield "text", html[at:]
            return
        if name in _RAW_END:
            end = _RAW_END[name].search(html, at)
            stop = end.start() if end else size
            text = html[at:stop]
            yield "text", unescape(text) if name in ESCAPED else text
            at = stop


# -- tree ------------------------------------------------------------------------------

class Tree:
    """The elements of a page, its first title and its style sheets."""

    def __init__(self, html: str):
        self.root = Node("body")
        self.stack = [self.root]
        self.open: Counter[str] = Counter()
        self.title: str | None = None
        self.sheets: list[str] = []
        for kind, *rest in tokens(html):
            getattr(self, kind)(*rest)

    def cut(self, place: int) -> None:
        """End the element at this place of the stack and all inside it."""
        if place > 0:
            self.open.subtract(n.name for n in self.stack[place:])
            del self.stack[place:]

    def find(self, names: frozenset[str], walls: frozenset[str]) -> int:
        """Place of the innermost open element of these names; 0 where a wall comes first."""
        if not any(self.open[name] for name in names):
            return 0
        for place in range(len(self.stack) - 1, 0, -1):
            name = self.stack[place].name
            if name in names:
                return place
            if name in walls:
                return 0
        return 0

    def put(self, node: Node) -> None:
        """Add to the current element, or before the table where that has no place for it."""
        here = self.stack[-1]
        if here.name in IN_TABLE and node.name not in TABLE_PARTS | UNSEEN:
            place = self.find(_names("table"), frozenset())
            before = self.stack[place - 1].children
            before.insert(max(0, len(before) - 1), node)
        else:
            here.children.append(node)

    def push(self, node: Node) -> None:
        if len(self.stack) >= DEPTH:
            self.cut(DEPTH - 1)
        self.put(node)
        self.stack.append(node)
        self.open[node.name] += 1

    def text(self, text: str) -> None:
        here = self.stack[-1]
        if here.name == "title" and self.title is None and not self.find(_names("svg"), frozenset()):
            self.title = " ".join(text.split())
        elif here.name == "style":
            self.sheets.append(text)
        elif here.name in PREFORMATTED and not here.children and text[:1] in "\r\n":
            text = text[2 if text.startswith("\r\n") else 1 :]
        if not text:
            return
        if here.name in IN_TABLE and not text.strip(_SPACE):
            return
        self.put(Node("", None, text))

    def start(self, name: str, attributes: dict, closed: bool) -> None:
        if name in ("html", "head", "body", "frameset"):
            return
        if name in TABLE_PARTS:
            if not self._table_part(name):
                return
        elif name == "table" and self.stack[-1].name in IN_TABLE:
            self.cut(self.find(_names("table"), frozenset()))
        if name in CLOSES_P:
            self.cut(self.find(_names("p"), WALLS))
        if name in HEADINGS and self.stack[-1].name in HEADINGS:
            self.cut(len(self.stack) - 1)
        elif name == "li":
            self.cut(self.find(_names("li"), SPECIAL - _names("address div p li")))
        elif name in ("dd", "dt"):
            self.cut(self.find(_names("dd dt"), SPECIAL - _names("address div p dd dt")))
        elif name in ("option", "optgroup"):
            self.cut(self.find(_names("option") if name == "option" else _names("option optgroup"), SPECIAL - _names("option optgroup")))
            if name == "optgroup":
                self.cut(self.find(_names("optgroup"), SPECIAL - _names("optgroup")))
        elif name == "button":
            self.cut(self.find(_names("button"), WALLS - _names("button")))
        node = Node(name, attributes)
        foreign = closed and (name in ("svg", "math") or self.find(_names("svg math"), WALLS))
        if name in VOID or foreign:
            self.put(node)
        else:
            self.push(node)

    def _table_part(self, name: str) -> bool:
        """Open what the part of a table belongs in; False outside of tables."""
        place = self.find(_names("table"), _names("template"))
        if not place:
            return False
        inside = [n.name for n in self.stack[place + 1 : place + 3]]
        section = int(bool(inside) and inside[0] in SECTIONS)
        row = section + int(inside[section : section + 1] == ["tr"])
        keep = row if name in CELLS else section if name == "tr" else 0
        self.cut(place + 1 + keep)
        if name in CELLS and row == section:
            self.push(Node("tr"))
        return True

    def end(self, name: str) -> None:
        if name in ("html", "head", "body"):
            return
        if name == "br":
            return self.put(Node("br"))
        if name == "p" and not self.find(_names("p"), WALLS):
            return self.put(Node("p"))
        if name in HEADINGS:
            return self.cut(self.find(HEADINGS, WALLS))
        if name in TABLE_PARTS or name == "table":
            return self.cut(self.find(_names(name), _names("table template") - _names(name)))
        if name in FORMATS:
            place = self.find(_names(name), WALLS)
            if place and any(n.name in SPECIAL for n in self.stack[place + 1 :]):
                del self.stack[place]  # the blocks inside stay open
                self.open[name] -= 1
            else:
                self.cut(place)
            return None
        walls = WALLS | LISTS if name == "li" else WALLS if name in SPECIAL else SPECIAL
        return self.cut(self.find(_names(name), walls - _names(name)))


# -- styles ----------------------------------------------------------------------------

def declarations(style: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for part in style.lower().split(";"):
        name, _, value = part.partition(":")
        if name.strip() in ("display", "visibility", "white-space"):
            out[name.strip()] = value.replace("!important", "").strip()
    return out


def rules(sheets: list[str]) -> dict[str, list[tuple]]:
    """By tag, class or id: (rank, tag, classes and ids, declarations) of the plain rules."""
    found: dict[str, list[tuple]] = {}
    for sheet in sheets:
        depth, skipped, selector, begin = 0, 0, "", 0
        sheet = re.sub(r"/\*.*?(?:\*/|\Z)", " ", sheet, flags=re.S)
        for mark in re.finditer(r"[{};]", sheet):
            at = mark.start()
            if mark[0] == "{":
                depth += 1
                if depth == 1:
                    selector, skipped = sheet[begin:at].strip(), 0
                    skipped, begin = selector.startswith("@"), at + 1
            elif mark[0] == "}":
                depth = max(0, depth - 1)
                if depth == 0:
                    wanted = {} if skipped else declarations(sheet[begin:at])
                    begin = at + 1
                    for one in selector.split(",") if wanted else ():
                        plain = _RULE.fullmatch(one.strip())
                        if plain and plain[0]:
                            tag = (plain[1] or "").lower().replace("*", "")
                            marks = re.findall(r"[.#][\w-]+", plain[2])
                            rank = (sum(m[0] == "#" for m in marks), len(marks), bool(tag))
                            found.setdefault(marks[0] if marks else tag or "*", []).append((rank, tag, marks, wanted))
            elif depth == 0:  # an @-rule without a block
                begin = at + 1
    return found


def style_of(node: Node, sheet: dict[str, list[tuple]]) -> dict[str, str]:
    """display, visibility and white-space that the page gives to an element."""
    a = node.attributes
    out: dict[str, str] = {}
    if sheet:
        own = {"." + c for c in a.get("class", "").split()}
        own |= {"#" + a["id"]} if "id" in a else set()
        meant = [r for key in (*sorted(own), node.name, "*") for r in sheet.get(key, ())]
        for _, tag, marks, wanted in sorted(meant, key=lambda r: r[0]):
            if tag in ("", node.name) and own.issuperset(marks):
                out |= wanted
    return out | declarations(a["style"]) if "style" in a else out


# -- rendering -------------------------------------------------------------------------

def width(text: str) -> int:
    """Columns a text takes; wide characters take two, marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Canvas:
    """Lines of a page or of a cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.blank = 0
        self.indent = ""
        self.first: str | None = None  # what the next line begins with, if not the indent

    def flush(self) -> None:
        if self.line:
            if self.lines:
                self.lines += [""] * self.blank
            begin = self.indent if self.first is None else self.first
            self.lines.append((begin + "".join(self.line)).rstrip(_SPACE))
            self.line, self.blank, self.first = [], 0, None
        self.space = False

    def block(self, blank: int) -> None:
        self.flush()
        self.blank = max(self.blank, blank)

    def line_break(self) -> None:
        if self.line:
            self.flush()
        else:
            self.blank = max(self.blank, 1)

    def text(self, text: str, kept: bool) -> None:
        if kept:
            for k, part in enumerate(re.split(r"\r\n?|\n", text)):
                if k:
                    self.line_break()
                if part:
                    self.line += [" ", part] if self.space and self.line else [part]
                    self.space = False
            return
        words = _SPACES.sub(" ", text)
        if words[0] == " ":
            self.space = bool(self.line)
        words_only = words.strip(" ")
        if words_only:
            if self.space:
                self.line.append(" ")
            self.line.append(words_only)
            self.space = words[-1] == " "


class Grid:
    """The cells of a table by row, with what they span."""

    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.taken: dict[int, int] = {}  # column: rows it stays occupied for

    def row(self) -> None:
        self.taken = {c: n - 1 for c, n in self.taken.items() if n > 1}
        self.rows.append([])

    def cell(self, lines: list[str], columns: int, rows: int) -> None:
        if not self.rows:
            self.row()
        last = self.rows[-1]
        at = last[-1][0] + last[-1][1] if last else 0
        while at in self.taken:
            at += 1
        columns = max(1, min(columns, COLUMNS - at))
        last.append((at, columns, lines))
        if rows > 1 and at < COLUMNS:
            # The row itself counts, as the next row takes one away.
            self.taken |= dict.fromkeys(range(at, at + columns), rows)

    def lines(self) -> list[str]:
        widths: dict[int, int] = {}
        for row in self.rows:
            for at, columns, lines in row:
                if columns == 1 and lines:
                    widths[at] = max(widths.get(at, 0), min(COLUMN, max(map(width, lines))))
                elif lines:
                    widths.setdefault(at, 1)
        offsets, total = {}, 0
        for c in sorted(widths):
            offsets[c] = min(total, WIDTH)
            total += widths[c] + 2
        out: list[str] = []
        for row in self.rows:
            height = max((len(lines) for _, _, lines in row), default=0)
            parts: list[list[str]] = [[] for _ in range(height)]
            filled = [0] * height
            for at, _, lines in row:
                for k, line in enumerate(lines):
                    if line:
                        gap = max(offsets[at] - filled[k], 2 if filled[k] else 0)
                        parts[k] += [" " * gap, line]
                        filled[k] += gap + width(line)
            out += ["".join(p) for p in parts]
        return out


def _integer(text: str | None, otherwise: int, least: int, most: int) -> int:
    found = _INTEGER.match(text or "")
    return min(max(int(found[1]), least), most) if found else otherwise


def render(html: str) -> tuple[str, str | None]:
    """Text and title of a page."""
    tree = Tree(html)
    sheet = rules(tree.sheets)
    page = Canvas()
    # What is open: nodes still to be drawn, or actions at the end of an element.
    canvas, grids, counters = [page], [], []
    todo: list[tuple] = [(tree.root, True, False)]

    def list_item(a: dict) -> str:
        if not counters or counters[-1] is None:
            return "* "
        counters[-1][0] = _integer(a.get("value"), counters[-1][0], -(10**9), 10**9)
        number = counters[-1][0]
        counters[-1][0] += counters[-1][1]
        return f"{number}. "

    while todo:
        node, seen, kept = todo.pop()
        if callable(node):
            node()
            continue
        name, a, here = node.name, node.attributes, canvas[-1]
        if not name:
            if seen:
                here.text(node.children, kept)
            continue
        hidden = name in HIDDEN or "hidden" in a or name == "dialog" and "open" not in a
        display = "none" if hidden else "block" if name in BLOCKS else "inline"
        if sheet or "style" in a:
            style = style_of(node, sheet)
            display = display if name in HIDDEN else style.get("display", display)
            seen = style["visibility"] not in ("hidden", "collapse") if style.get("visibility", "inherit") != "inherit" else seen
            space = style.get("white-space")
            kept = space.startswith(("pre", "break-spaces")) if space else kept or name in PREFORMATTED
        else:
            kept = kept or name in PREFORMATTED
        if display == "none":
            continue
        if name == "br":
            here.line_break()
            continue
        if name == "table":
            here.block(1)
            grids.append(Grid())

            def leave(here=here):
                for line in grids.pop().lines():
                    here.line_break() if not line else here.line.append(line)
                    here.flush()
                here.block(1)
        elif name == "tr" and grids:
            grids[-1].row()
            leave = None
        elif name in CELLS and grids:
            canvas.append(Canvas())

            def leave(a=a, grid=grids[-1]):
                own = canvas.pop()
                own.flush()
                grid.cell(own.lines, _integer(a.get("colspan"), 1, 1, COLUMNS), _integer(a.get("rowspan"), 1, 0, 65534) or 65534)
        elif name == "caption" and grids:
            canvas.append(Canvas())

            def leave(grid=grids[-1]):
                own = canvas.pop()
                own.flush()
                for line in own.lines:
                    canvas[-1].line.append(line or " ")
                    canvas[-1].flush()
        elif name in LISTS:
            here.block(0 if counters else 1)
            items = sum(c.name == "li" for c in node.children) if "reversed" in a else 1
            start = _integer(a.get("start"), items, -(10**9), 10**9)
            counters.append([start, -1 if "reversed" in a else 1] if name == "ol" else None)

            def leave(here=here):
                counters.pop()
                here.block(0 if counters else 1)
        elif name == "li":
            here.block(0)
            if here.first is not None:  # a list begins inside an item without a text
                here.line.append("")
                here.flush()
            outer = here.indent
            if seen:
                marker = list_item(a)
                here.first = outer + marker
                here.indent = (outer + " " * len(marker))[:INDENT]

            def leave(here=here, outer=outer):
                here.block(0)
                here.indent, here.first = outer, None
        elif name in ("blockquote", "dd"):
            here.block(int(name == "blockquote"))
            outer = here.indent
            here.indent = (outer + "  ")[:INDENT]

            def leave(here=here, outer=outer, blank=int(name == "blockquote")):
                here.block(blank)
                here.indent = outer
        elif display.startswith("inline") or display == "contents":
            leave = None
        else:
            blank = int(name in SPACED)
            here.block(blank)

            def leave(here=here, blank=blank):
                here.block(blank)
        if leave:
            todo.append((leave, seen, kept))
        todo += [(child, seen, kept) for child in reversed(node.children)]
    page.flush()
    return "\n".join(page.lines).strip("\n"), tree.title


# -- the query -------------------------------------------------------------------------

def html_text(pages: DataFrame) -> DataFrame:
    """page_id, title and text of every row of ``pages`` (page_id, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [(None, None) if h is None else render(h) for h in batch.column("html").to_pylist()]
            columns = [batch.column("page_id"), pa.array([t for _, t in found], pa.string()), pa.array([t for t, _ in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "title", "text"])

    wanted = pages.select(F.col("page_id").cast("long"), F.col("html").cast("string"))
    return wanted.mapInArrow(run, "page_id long, title string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"))
