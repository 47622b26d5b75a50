"""HTML extraction: a tree with implied tags, visibility rules, and a layout of blocks, lists and aligned table cells.

Each page is parsed by itself, so a table of pages is one pass without a shuffle. Elements that HTML closes without an end
tag (p before a block, li, dt, dd, options, table parts, head before what can't be in it) are closed here; stray end tags are
passed over. Not shown: head, script, style, template and the like, closed dialogs, what in an svg isn't text, elements that
are hidden or styled display:none with all below them, and text whose nearest element that says so is visibility:hidden.
Layout: white space collapses outside pre; blocks begin on a line of their own, and paragraphs, headings, lists, tables,
quotes and pre have an empty line around them, as have two br in a row; list items have "- " or their number and indent what
is below them, as dd does (lists may count backwards, by letters or roman numbers); buttons show their value; cells of a table stand in a grid (colspan, rowspan) and are padded to the width of their column, with two
spaces between. Only if a table would become much larger by this (ROOM, TIMES) do cells of more than WIDE characters move the
rest of their line instead of widening their column.

Time and the text's size are in proportion to the page: tags are read forwards only, open elements are found by their depth,
no function calls itself, and padding has limits (PADDED and so on). Defined results: null or empty html gives an empty text and
title; text without tags is laid out as it is; an unclosed comment, raw element or tag hides the rest of the page; control
characters 0 and 1 are left out; repeated rows each have a row; result columns replace input columns.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlog.llm import common as C

# Elements of HTML by how they are parsed and shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style template noscript iframe object audio video canvas datalist noframes noembed desc metadata defs symbol".split())
RAW = frozenset("script style noscript iframe template noframes noembed title textarea".split())
PRE = frozenset("pre listing textarea".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre listing figure fieldset hr details".split())
BLOCK = SPACED | frozenset("html body div section article aside nav main header footer form address li dt dd figcaption center summary legend caption tr td th thead tbody tfoot option optgroup select textarea hgroup search menu dir dialog".split())
#: A start tag closes these open elements, unless one of the second set is in between.
CLOSES = {
    **{t: ({"p"}, {"table", "td", "th", "button", "li", "dd", "dt", "div", "blockquote", "section", "article"}) for t in BLOCK - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "li", "dt", "dd", "option", "optgroup", "caption", "select"}},
    "li": ({"li", "p"}, {"ul", "ol", "menu", "table"}), "dt": ({"dt", "dd", "p"}, {"dl", "table"}), "dd": ({"dt", "dd", "p"}, {"dl", "table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "p", "caption"}, {"table", "tr"}), "th": ({"td", "th", "p", "caption"}, {"table", "tr"}), "tr": ({"tr", "td", "th", "p", "caption"}, {"table"}),
    **{t: ({"thead", "tbody", "tfoot", "tr", "td", "th", "p", "caption"}, {"table"}) for t in ("thead", "tbody", "tfoot")},
}
#: Start tags that leave an open head open; any other one and text end it.
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())
#: What these elements need around them.
PARENT = {"td": "tr", "th": "tr", "tr": "table"}

SPACE = re.compile(r"[ \t\n\f\r]+")
NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
#: What is left of a tag, if it is written as most are; else its attributes are read one by one.
PLAIN_TAG = re.compile(r"""((?:\s++[^\s"'<>/=]++(?:=(?:"[^"]*+"|'[^']*+'|[^\s"'=<>`]++))?+)*+)\s*+/?>""")
ATTR = re.compile(r"""[\s/]*+(?:(=?[^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?)""")
#: Attributes that matter here.
MATTERS = re.compile(r"hidden|style|span|start|value|type|open|reversed", re.I)
NUMBER = re.compile(r"\s*(-?\d{1,9})")
COMMENT_END = re.compile("--!?>")
#: Characters up to which a line is padded and lists indent; tables in tables that are aligned.
#: (Deeper tables show their cells one below the other. Nothing is lost; without these a small page could make gigabytes.)
PADDED, INDENTED, DEEP = 2000, 80, 32
#: An aligned table may take ROOM characters and TIMES those that it shows; in a larger one only cells of WIDE widen columns.
ROOM, TIMES, WIDE = 16_384, 8, 200
NOTE = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
DECLARATION = re.compile(r"""(?:[^;"'(]|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|\([^)]*(?:\)|\Z))+""")
#: Words of valid values, as a browser passes over a declaration of any other.
VALUES = {
    "display": frozenset("""none contents block inline inline-block flow flow-root flex inline-flex grid inline-grid table inline-table table-row table-cell table-column table-caption table-row-group
    table-header-group table-footer-group table-column-group list-item run-in ruby math inherit initial unset revert revert-layer""".split()),
    "visibility": frozenset("visible hidden collapse inherit initial unset revert revert-layer".split()),
}


def attributes(raw: str) -> dict[str, str]:
    """Values by lower-case name; the first of a name counts, a quote that never closes is a sign of its value."""
    found: dict[str, str] = {}
    for name, *values in ATTR.findall(raw):
        if name:
            found.setdefault(name.lower(), entities.unescape("".join(values)))
    return found


def styles(style: str) -> dict[str, str]:
    """display and visibility, where declared: the last valid declaration counts, important ones before others."""
    found: dict[str, tuple[bool, str]] = {}
    for part in DECLARATION.findall(NOTE.sub(" ", style.lower())):
        name, _, value = part.partition(":")
        value, mark, _ = value.partition("!")
        name, value, important = name.strip(), value.strip(), bool(mark)
        if name in VALUES and value and VALUES[name].issuperset(value.split()) and important >= found.get(name, (False,))[0]:
            found[name] = important, value
    return {name: value for name, (_, value) in found.items()}


class Node:
    """An element: shown is false if it has no box, visible is None where its parent's visibility holds."""

    __slots__ = ("tag", "attrs", "kids", "shown", "visible")

    def __init__(self, tag: str, raw: str = ""):
        self.tag, self.kids = tag, []
        self.attrs = attributes(raw) if raw and MATTERS.search(raw) else {}
        self.shown, self.visible = tag not in HIDDEN and (tag != "dialog" or "open" in self.attrs), None
        if self.attrs:
            said = styles(self.attrs["style"]) if "style" in self.attrs else {}
            self.shown = self.shown and ("hidden" not in self.attrs or "display" in said) and said.get("display") != "none"
            if tag == "input" and self.attrs.get("type", "").lower() == "hidden":
                self.shown = False
            if said.get("visibility") in ("visible", "hidden", "collapse"):
                self.visible = said["visibility"] == "visible"

    def number(self, name: str, default: int) -> int:
        found = NUMBER.match(self.attrs.get(name, ""))
        return int(found[1]) if found else default


def rest_of_tag(page: str, at: int) -> tuple[str, int]:
    """Attributes of a tag, from behind its name, and the place behind its end; -1 where the page ends first."""
    found = PLAIN_TAG.match(page, at)
    if found:
        return found[1], found.end()
    begin, end = at, len(page)
    while at < end:
        if page[at] == ">":
            return page[begin:at], at + 1
        at = max(ATTR.match(page, at).end(), at + (page[at] in "\"'"))
    return "", -1


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", tag, attributes), ("close", tag, "") and ("raw", tag, text), in order."""
    begin = at = 0
    end = len(page)
    while (at := page.find("<", at)) >= 0:
        name = NAME.match(page, at + 1)
        if not name and page[at + 1 : at + 2] not in ("!", "?", "/"):
            at += 1  # a sign like any other
            continue
        if at > begin:
            yield "text", page[begin:at], ""
        if not name:
            if page.startswith("<!--", at):
                found = COMMENT_END.search(page, at + 4)
                at = at + 5 if page.startswith(">", at + 4) else at + 6 if page.startswith("->", at + 4) else found.end() if found else -1
            else:
                at = page.find(">", at) + 1 or -1
            if at < 0:
                return
            begin = at
            continue
        tag = name[2].lower()
        raw, at = rest_of_tag(page, name.end())
        if at < 0:
            return
        begin = at
        if name[1]:
            yield "close", tag, ""
            continue
        yield "open", tag, raw
        if tag in RAW:
            found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            yield "raw", tag, page[at : found.start() if found else end]
            _, at = rest_of_tag(page, found.end()) if found else ("", -1)
            if at < 0:
                return
            begin = at
    if begin < end:
        yield "text", page[begin:], ""


def parse(page: str) -> tuple[Node, str]:
    """The tree of a page (texts are kids as strings) and its title."""
    root = Node("html")
    stack, title = [root], ""
    depths: dict[str, list[int]] = {}  # of the open elements, by tag

    def open_tag(tag: str, raw: str = "") -> None:
        node = Node(tag, raw)
        stack[-1].kids.append(node)
        depths.setdefault(tag, []).append(len(stack))
        stack.append(node)

    def close(depth: int) -> None:
        """Closes all that is open from a depth on."""
        while len(stack) > depth:
            depths[stack.pop().tag].pop()

    def innermost(tags) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=0)

    def end_head() -> None:
        if depths.get("head"):
            close(depths["head"][-1])

    page = page.replace("\0", "").replace("\1", "")
    for kind, tag, more in tokens(page):
        if kind == "text":
            if depths.get("head") and not SPACE.fullmatch(tag):
                end_head()
            stack[-1].kids.append(tag)
        elif kind == "raw":
            if tag == "title":
                title = title or ("" if depths.get("svg") else SPACE.sub(" ", entities.unescape(more)).strip())
            elif tag == "textarea":
                open_tag(tag)
                stack[-1].kids.append(more)
                close(len(stack) - 1)
        elif kind == "close":
            if tag == "br":
                end_head()
                stack[-1].kids.append(Node("br"))
            elif depths.get(tag):
                close(depths[tag][-1])
        elif tag != "html" and not (tag in ("head", "body") and depths.get(tag)):
            if tag not in IN_HEAD:
                end_head()
            if tag in CLOSES:
                ends, stops = CLOSES[tag]
                above = innermost(stops)
                found = [d[bisect_right(d, above)] for d in (depths.get(t) for t in ends) if d and d[-1] > above]
                if found:
                    close(min(found))
            if tag in PARENT and stack[-1].tag not in ("tr", "table", "thead", "tbody", "tfoot") and not depths.get("table"):
                open_tag("table")
            if PARENT.get(tag) == "tr" and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
                open_tag("tr")
            if tag in VOID:
                stack[-1].kids.append(Node(tag, more))
            elif tag not in RAW:
                open_tag(tag, more)
    return root, title


#: Blanks and tabs of preformatted text, while a line is made.
KEPT, BACK = str.maketrans(" \t", "\0\1"), str.maketrans("\0\1", " \t")


class Flow:
    """Lines in the making: pending text, and whether a line or an empty line must come before the next text."""

    def __init__(self):
        self.lines, self.text, self.gap, self.marks, self.indent, self.broken = [], [], 0, [], "", False

    def line(self) -> str:
        found = SPACE.sub(" ", "".join(self.text)).strip(" ").translate(BACK).rstrip() if self.text else ""
        self.text = []
        return found

    def flush(self, gap: int) -> None:
        """Ends a line if there is one."""
        if line := self.line():
            self.put(line)
        self.gap, self.broken = max(self.gap, gap), False

    def end_line(self, pre: bool) -> None:
        """Ends a line, also an empty one of preformatted text; elsewhere a second br in a row makes an empty line."""
        if line := self.line():
            self.put(line)
            self.gap, self.broken = max(self.gap, 1), True
        elif pre:
            self.put("")
        else:
            self.gap, self.broken = max(self.gap, 2 if self.broken else 1), True

    def put(self, line: str) -> None:
        if self.gap > 1 and self.lines and self.lines[-1]:
            self.lines.append("")
        lead = self.indent
        if self.marks and line:
            mark = "".join(self.marks)
            lead = self.indent[: max(0, len(self.indent) - len(mark))] + mark
            self.marks = []
        self.lines.append(lead + line if line else "")
        self.gap = 0

    def put_all(self, lines: list, deep: bool) -> None:
        """Lines of a table, which may hold lists of lines; they are taken as they are where nothing is to be put before them."""
        if deep or not (self.indent or self.marks):
            if lines:
                if self.gap > 1 and self.lines and self.lines[-1]:
                    self.lines.append("")
                self.lines.append(lines)
                self.gap = 0
        else:
            for line in flat(lines):
                self.put(line)


def flat(lines: list) -> list[str]:
    """Lines of lists within lists."""
    out, todo = [], [iter(lines)]
    while todo:
        for x in todo[-1]:
            if not isinstance(x, str):
                todo.append(iter(x))
                break
            out.append(x)
        else:
            todo.pop()
    return out


def counter(node: Node) -> tuple[int, int, str]:
    """First number, step and kind of the numbers of an ordered list."""
    back = "reversed" in node.attrs
    first = sum(not isinstance(k, str) and k.tag == "li" for k in node.kids) if back else 1
    return node.number("start", first), -1 if back else 1, node.attrs.get("type", "1")


def numeral(n: int, kind: str) -> str:
    """A number as a list of that kind (a, A, i, I) shows it; numbers that have no letters or roman form stay decimal."""
    if kind in ("a", "A") and n > 0:
        out = ""
        while n:
            n, k = divmod(n - 1, 26)
            out = chr(ord(kind) + k) + out
        return out
    if kind in ("i", "I") and 0 < n < 4000:
        out = ""
        for value, sign in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split(), strict=True):
            out += sign * (n // value)
            n %= value
        return out if kind == "i" else out.upper()
    return str(n)


def layout(node: Node, visible: bool, tables: dict[int, list], deep: bool = False) -> list:
    """Lines (and lists of lines) of what a node shows, tables in it being laid out already; kids are walked with a stack of their iterators."""
    flow, within_list = Flow(), ("ul", "ol")
    gap_of = lambda tag: 2 if tag in SPACED and (tag not in within_list or not flow.indent) else 1
    stack = [(node, iter(node.kids), None, visible, node.tag in PRE, node.tag == "svg")]
    counters: list = []  # of the open lists
    while stack:
        here, kids, undo, visible, pre, drawn = stack[-1]
        kid = next(kids, None)
        if kid is None:
            stack.pop()
            if here.tag in BLOCK:
                flow.flush(gap_of(here.tag))
            if here.tag == "li":
                flow.marks, flow.indent = [], undo
            elif here.tag == "dd":
                flow.indent = undo
            elif here.tag in within_list:
                counters.pop()
        elif isinstance(kid, str):
            if not visible or drawn:
                continue
            text = entities.unescape(kid) if "&" in kid else kid
            if not pre:
                flow.text.append(text)
                continue
            first, *rest = text.replace("\r\n", "\n").translate(KEPT).split("\n")
            if rest and not first and kid is here.kids[0] and here.tag in PRE:
                first, *rest = rest  # a line end right behind the tag doesn't count
            flow.text.append(first)
            for line in rest:
                flow.end_line(True)
                flow.text = [line]
        elif not kid.shown:
            continue
        elif kid.tag == "br":
            if visible:
                flow.end_line(pre)
        elif kid.tag == "table":
            flow.flush(2)
            flow.put_all(tables.pop(id(kid)), deep)
            flow.gap = 2
        else:
            undo = None
            if kid.tag in BLOCK:
                flow.flush(gap_of(kid.tag))
            if kid.tag in within_list:
                counters.append(counter(kid) if kid.tag == "ol" else None)
            elif kid.tag == "input":
                if visible and kid.attrs.get("type", "").lower() in ("submit", "reset", "button"):
                    flow.text.append(kid.attrs.get("value", ""))
            elif kid.tag == "dd":
                undo = flow.indent
                flow.indent = (flow.indent + " " * 4)[:INDENTED]
            elif kid.tag == "li":
                mark = "- "
                if counters and counters[-1] is not None:
                    number, step, kind = counters[-1]
                    number = kid.number("value", number)
                    mark = f"{numeral(number, kid.attrs.get('type', kind))}. "
                    counters[-1] = number + step, step, kind
                undo = flow.indent
                flow.marks.append(mark)
                flow.indent = (flow.indent + " " * len(mark))[:INDENTED]
            seen = visible if kid.visible is None else kid.visible
            stack.append((kid, iter(kid.kids), undo, seen, pre or kid.tag in PRE, kid.tag == "svg" or (drawn and kid.tag not in ("text", "foreignobject"))))
    flow.flush(0)
    return flow.lines


def grid(rows: list[list[tuple[list, int, int]]]) -> list[list[tuple[int, int, list]]]:
    """rows of cells (lines, colspan, rowspan) to rows of (first column, last column + 1, lines)."""
    taken: list[tuple[int, int, int]] = []  # columns from, to, and the row where they are free again
    out = []
    for y, row in enumerate(rows):
        taken = [t for t in taken if t[2] > y]
        placed, x, k = [], 0, 0
        for lines, across, down in row:
            while k < len(taken) and taken[k][0] < x + across:
                if taken[k][1] > x:
                    x = taken[k][1]
                k += 1
            placed.append((x, x + across, lines, y + down if down else len(rows)))
            x += across
        out.append([p[:3] for p in placed])
        joined: list[tuple[int, int, int]] = []
        for t in sorted([*taken, *[(a, b, until) for a, b, _, until in placed if until > y + 1]]):
            if joined and joined[-1][1] == t[0] and joined[-1][2] == t[2]:
                joined[-1] = (joined[-1][0], t[1], t[2])
            else:
                joined.append(t)
        taken = joined
    return out


def table(node: Node, visible: bool, tables: dict[int, list], deep: bool) -> list:
    """Lines of a table, each cell padded to its columns; what stands in a table but in no cell comes before it."""
    rows, above, todo = [], [], [(k, visible) for k in reversed(node.kids)]

    def loose(text: str, seen: bool) -> None:
        if seen and (text := SPACE.sub(" ", entities.unescape(text)).strip()):
            above.append(text)

    while todo:
        kid, seen = todo.pop()
        if isinstance(kid, str):
            loose(kid, seen)
            continue
        if not kid.shown:
            continue
        seen = seen if kid.visible is None else kid.visible
        if kid.tag in ("thead", "tbody", "tfoot"):
            todo.extend((k, seen) for k in reversed(kid.kids))
        elif kid.tag == "tr":
            cells = []
            for c in kid.kids:
                if isinstance(c, str):
                    loose(c, seen)
                elif c.shown:
                    own = seen if c.visible is None else c.visible
                    cells.append((layout(c, own, tables, deep), min(max(1, c.number("colspan", 1)), 1000), min(max(0, c.number("rowspan", 1)), 65534)))
            rows.append(cells)
        else:
            above.append(tables.pop(id(kid)) if kid.tag == "table" else layout(kid, seen, tables, deep))
    if deep or all(len(row) < 2 for row in rows) and not any(down != 1 for row in rows for _, _, down in row):  # one column needs no padding
        found = [x for x in above + [lines for row in rows for lines, _, _ in row] if x]
        return found[0] if len(found) == 1 and not isinstance(found[0], str) else found
    placed = grid([[(flat(lines), across, down) for lines, across, down in row] for row in rows])
    starts = sorted({a for row in placed for a, _, _ in row})  # columns in which no cell begins have no width
    width, wider = [0] * len(starts), []
    height, shown = sum(max((len(lines) for _, _, lines in row), default=0) for row in placed), sum(len(x) - x.count(" ") for row in placed for _, _, lines in row for x in lines)
    widest: dict[int, int] = {}
    for row in placed:
        for a, _, lines in row:
            widest[a] = max(widest.get(a, 0), max(map(len, lines), default=0))
    most = PADDED if height * sum(widest.values()) <= ROOM + TIMES * shown else WIDE
    for row in placed:
        for a, b, lines in row:
            first, last = bisect_left(starts, a), bisect_left(starts, b)
            size = max((len(x) for x in lines if len(x) <= most), default=0)
            if last - first == 1:
                width[first] = max(width[first], size)
            else:
                wider.append((last - first, first, last, size))
    for n, first, last, size in sorted(wider):
        if n * 2 - 2 < size and (short := size - sum(width[first:last]) - 2 * (n - 1)) > 0:
            width[last - 1] += short
    left = [0]
    for w in width:
        left.append(left[-1] + w + 2)
    out = above
    for row in placed:
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            line, size = [], 0
            for a, _, lines in row:
                if k < len(lines) and lines[k]:
                    to = left[bisect_left(starts, a)]
                    pad = max(to - size if max(to, len(lines[k])) <= PADDED else 0, 2 if size else 0)
                    line += [" " * pad, lines[k]]
                    size += pad + len(lines[k])
            out.append("".join(line).rstrip())
    return out


def page_text(page: str | None) -> tuple[str, str]:
    """Title and visible text of a page."""
    root, title = parse(page or "")
    found, todo = [], [(root, True, 0)]
    while todo:  # tables in the order of the page, so a table in another comes behind it
        node, visible, level = todo.pop()
        visible = visible if node.visible is None else node.visible
        if node.tag == "table":
            found.append((node, visible, level >= DEEP))
            level += 1
        todo.extend((k, visible, level) for k in reversed(node.kids) if not isinstance(k, str) and k.shown)
    tables: dict[int, list] = {}
    for node, visible, deep in reversed(found):
        tables[id(node)] = table(node, visible, tables, deep)
    return title, "\n".join(flat(layout(root, True, tables))).strip("\n")


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, title, text, n_lines), a row per row of pages."""
    rows = pages.select(F.col(key).alias(key), F.col(html).alias("_html"))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [page_text(x) for x in b.column("_html").to_pylist()]
            lines = [x.count("\n") + 1 if x else 0 for _, x in found]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([t for t, _ in found], pa.string()), pa.array([x for _, x in found], pa.string()), pa.array(lines, pa.int64())], [key, "title", "text", "n_lines"])

    return rows.mapInArrow(run, f"`{key}` {kind}, title string, text string, n_lines long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(C.table(spark, sf_dir, "pages"))
