"""Layout-aware rendering of HTML: a tree builder with implied tags, visibility rules, and a renderer for visible text.

Blocks start on lines of their own, with a blank line around those that have margins; list items get bullets or numbers
and the depth's indent; table cells are laid out in columns, spans over several columns and rows included; ``pre`` and
``textarea`` keep their white space; elsewhere white space collapses. Nothing visible is dropped: options and fallbacks
of objects without data show, of closed ``details`` the summary, of drawings the text, and what is visible within
invisible elements. Closed dialogs, fallbacks of players and canvases, and what styles or attributes hide, don't show. The
end tag of a hidden or replaced element ends it whatever is open inside, so that it never swallows what follows. Building
and rendering keep explicit stacks, so depth is no limit.

Defined cases: null and empty html give the empty text; unclosed tags end where their parent ends, a tag that the end of
the page cuts off is dropped, as browsers do; a column wider than ``PAD`` characters doesn't widen the other rows; bad
list numbers and spans count as 1; repeated rows are rendered one by one; an empty table gives an empty table; a very long
page is one row's work, in time proportional to its length; columns other than the named ones aren't read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Cells are padded up to so many characters.
PAD = 120

# Classes of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("textarea title".split())
HIDDEN = frozenset(
    "area audio base canvas datalist defs desc embed head iframe link meta metadata noembed noframes param rp script source style symbol template "
    "title track video".split()
)
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
BLOCKS = SPACED | frozenset(
    "address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup html legend li main nav "
    "optgroup option search section summary tbody td tfoot th thead tr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre search section summary table ul li dt dd".split()
)
LISTS = frozenset("ol ul menu dir".split())
#: Their end tags end whatever is open inside, up to the scope.
REPLACED = frozenset("applet audio canvas datalist marquee math noscript object select svg video".split())
#: An opening tag ends the open elements of the first set, up to an element of the second.
IMPLIED = {
    "li": (frozenset({"li"}), LISTS),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "tr": (frozenset({"td", "th", "tr", "caption", "colgroup"}), frozenset({"table"})),
    "tbody": (frozenset({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}), frozenset({"table"})),
    "body": (frozenset({"head"}), frozenset({"body"})),
}
IMPLIED |= {k: IMPLIED["tbody"] for k in ("thead", "tfoot", "caption", "colgroup")}
#: What an end tag or an implied end doesn't reach through.
SCOPE = frozenset("table td th caption html template button".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'=<>`]++)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.IGNORECASE)


@dataclass(slots=True)
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): text, open, close and empty tokens."""
    at, n = 0, len(html)
    lower = None
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", html[at:], ""
            return
        if lt > at:
            yield "text", html[at:lt], ""
        m = _TAG.match(html, lt) or _LOOSE.match(html, lt)
        if m:
            closing, name, rest = m[1], m[2].lower(), m[3]
            at = m.end()
            if closing:
                yield "close", name, ""
                continue
            yield ("empty" if name in VOID else "open"), name, rest
            if name in RAW or name in RCDATA:
                lower = lower if lower is not None else html.lower() if html.isascii() else re.sub("[A-Z]", lambda c: c[0].lower(), html)
                end = lower.find(f"</{name}", at)
                end = n if end < 0 else end
                if end > at:
                    yield ("raw" if name in RAW else "text"), html[at:end], ""
                at = end
        elif html.startswith("<!--", lt):
            end = html.find("-->", lt + 2 if html.startswith("<!-->", lt) else lt + 4)
            at = n if end < 0 else end + 3
        elif lt + 1 < n and html[lt + 1] in "!?/":
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
        elif lt + 1 < n and html[lt + 1].isascii() and html[lt + 1].isalpha():
            return  # a tag that never ends
        else:
            yield "text", "<", ""
            at = lt + 1


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def tree(html: str) -> Node:
    """The document's tree; every element has the place that implied start and end tags give it."""
    root = Node("html")
    stack = [root]
    places: dict[str, list[int]] = {}  # of open elements by name, so that an end tag without its element costs no walk

    def end(k: int) -> None:
        for x in reversed(stack[k:]):
            places[x.tag].pop()
        del stack[k:]

    def close(names: frozenset, until: frozenset) -> None:
        """End the innermost open element of ``names``, if nothing of ``until`` is between."""
        if not any(places.get(x) for x in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                return end(k)
            if stack[k].tag in until:
                return None

    def open_(name: str, own: dict[str, str], stays: bool) -> None:
        node = Node(name, own)
        stack[-1].children.append(node)
        if stays:
            places.setdefault(name, []).append(len(stack))
            stack.append(node)

    for kind, name, rest in tokens(html):
        if kind in ("text", "raw"):
            if kind == "text" and stack[-1].tag == "head" and name.strip():
                end(len(stack) - 1)
            stack[-1].children.append(unescape(name) if kind == "text" else name)
        elif kind == "close":
            if name in ("html", "body"):
                continue
            if name == "br":
                open_("br", {}, False)
            elif name == "p" and not places.get("p"):
                open_("p", {}, False)
            elif name in SCOPE:
                close(frozenset({name}), frozenset({"table"}) if name in ("td", "th", "caption") else frozenset())
            elif name in BLOCKS:
                close(frozenset({name}), SCOPE)
            elif places.get(name) and hides(stack[places[name][-1]]):
                end(places[name][-1])
            else:  # an inline element's end tag doesn't end blocks within it
                close(frozenset({name}), SCOPE if name in REPLACED else SCOPE | BLOCKS)
        else:
            if name == "html":
                root.attributes = attributes(rest) | root.attributes
                continue
            if stack[-1].tag == "head" and name not in HEAD_ONLY:
                end(len(stack) - 1)
            if name in CLOSES_P:
                close(frozenset({"p"}), SCOPE)
            for own in ("option", "optgroup") if name == "optgroup" else ("option",) if name == "option" else ():
                if stack[-1].tag == own:
                    end(len(stack) - 1)
            if name in IMPLIED:
                names, until = IMPLIED[name]
                before = -1
                while before != len(stack):  # a row ends its cell, then the row before
                    before = len(stack)
                    close(names, until)
            if name in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                open_("tr", {}, True)
            open_(name, attributes(rest) if rest else {}, kind == "open")
    return root


def styled(node: Node) -> dict[str, str]:
    """The element's own display and visibility; the last declaration counts."""
    style = node.attributes.get("style") if node.attributes else None
    return {k.lower(): v.lower() for k, v in _STYLE.findall(style)} if style else {}


def hides(node: Node) -> bool:
    """Does the element take no place, with all that is in it?"""
    a = node.attributes
    if node.tag in HIDDEN or node.tag == "object" and "data" in a or node.tag == "dialog" and "open" not in a:
        return True
    if not a:
        return False
    display = styled(node).get("display")
    return display == "none" if display else "hidden" in a and a["hidden"].lower() != "until-found"


class _Canvas:
    """Lines so far, the open line, and the blank line that is due before the next text."""

    __slots__ = ("gap", "line", "lines", "marks", "space")

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line = ""
        self.space = False
        self.gap = False
        self.marks: list[list] = []  # open list items: [indent, bullet or None once written]

    def end_line(self) -> None:
        if self.line:
            self.lines.append(self.line)
        self.line, self.space = "", False

    def blank(self) -> None:
        self.end_line()
        self.gap = True

    def _prefix(self) -> str:
        if not self.marks:
            return ""
        indent, bullet = self.marks[-1]
        self.marks[-1][1] = None
        return " " * indent + (bullet or "  ") if bullet is not None else " " * (indent + 2)

    def _start(self) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.line = self._prefix()

    def text(self, text: str) -> None:
        words = _SPACE.sub(" ", text)
        if words == " " or not words:
            self.space = self.space or bool(words)
            return
        if not self.line:
            self._start()
            words = words.lstrip(" ")
        elif self.space and words[0] != " ":
            words = " " + words
        self.space = words[-1] == " "
        self.line += words[:-1] if self.space else words

    def kept(self, lines: list[str]) -> None:
        """Lines whose blanks matter."""
        for k, x in enumerate(lines):
            if k:
                self.end_line() if self.line else self.lines.append("")
            if x:
                if not self.line:
                    self._start()
                self.line += x

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class _Table:
    """Cells by row: (first column, columns, lines). Cells of rows above may reach down."""

    __slots__ = ("down", "rows")

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.down: list[tuple[int, int, int]] = []  # [start, end) of columns taken up to a row

    def row(self) -> None:
        self.rows.append([])
        now = len(self.rows) - 1
        left: list[tuple[int, int, int]] = []
        for start, stop, until in sorted(x for x in self.down if x[2] > now):
            if left and left[-1][1] == start and left[-1][2] == until:
                left[-1] = (left[-1][0], stop, until)
            else:
                left.append((start, stop, until))
        self.down = left

    def cell(self, lines: list[str], columns: int, rows: int) -> None:
        if not self.rows:
            self.row()
        own = self.rows[-1]
        at = own[-1][0] + own[-1][1] if own else 0
        now = len(self.rows) - 1
        k = bisect_left(self.down, (at, -1, -1))
        for start, stop, until in self.down[max(0, k - 1) :]:
            if start > at:
                break
            at = stop if stop > at and until > now else at
        own.append((at, columns, lines))
        if rows != 1:
            insort(self.down, (at, at + columns, now + rows if rows else 1 << 40))

    def lay_out(self) -> list[str]:
        """Rows of cells as lines, each column as wide as its widest cell needs (``PAD`` at most); a wide cell widens its last column."""
        starts = sorted({at for row in self.rows for at, _, _ in row})
        width = [0] * len(starts)
        for many in (False, True):
            for row in self.rows:
                for at, columns, lines in row:
                    first, stop = bisect_left(starts, at), bisect_left(starts, at + columns)
                    if (stop - first > 1) == many:
                        need = min(max(map(len, lines), default=0), PAD)
                        width[stop - 1] += max(0, need - sum(width[first:stop]) - 2 * (stop - first - 1))
        place, edge = {}, 0
        for at, w in zip(starts, width, strict=True):
            place[at] = edge
            edge += w + 2
        out = []
        for row in self.rows:
            for n in range(max((len(lines) for _, _, lines in row), default=0)):
                line = ""
                for k, (at, _, lines) in enumerate(row):
                    line = line.ljust(place[at]) if not k or len(line) + 2 <= place[at] else f"{line}  "
                    line += lines[n] if n < len(lines) else ""
                out.append(line.rstrip())
        return out


def render(root: Node) -> str:
    """Visible text of a tree."""
    page = _Canvas()
    canvas = [page]
    tables: list[_Table] = []
    counters: list[list[int | None]] = []
    pre = svg = svg_text = 0
    mute = [False]
    todo: list[tuple] = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        now = canvas[-1]
        if isinstance(node, str):
            if mute[-1] or svg and not svg_text:
                continue
            if pre:
                now.kept(node.replace("\r\n", "\n").replace("\t", "    ").split("\n"))
            elif not (_between_cells(leaving) and not node.strip()):
                now.text(node)
            continue
        tag = node.tag
        if not leaving:
            if hides(node):
                continue
            todo.append((node, True))
            if node.attributes and (seen := styled(node).get("visibility")):
                mute.append(seen in ("hidden", "collapse") if seen != "inherit" else mute[-1])
            svg += tag == "svg"
            svg_text += tag in _DRAWN
            if tag == "br":
                if now.line:
                    now.end_line()
                else:
                    now.gap = bool(now.lines)
            elif tag == "hr":
                now.blank()
            elif tag == "table":
                now.blank()
                tables.append(_Table())
            elif tag == "tr" and tables:
                tables[-1].row()
            elif tag in ("td", "th") and tables:
                canvas.append(_Canvas())
            elif tag in LISTS:
                (now.end_line if counters else now.blank)()
                counters.append([_number(node.attributes.get("start")) if tag == "ol" else None])
            elif tag == "li":
                now.end_line()
                count = counters[-1] if counters else [None]
                if count[0] is not None and "value" in node.attributes:
                    count[0] = _number(node.attributes["value"])
                bullet = "* " if count[0] is None else f"{count[0]}. "
                if count[0] is not None:
                    count[0] += 1
                now.marks.append([2 * max(0, len(counters) - 1), bullet])
            elif tag in ("pre", "textarea"):
                (now.blank if tag == "pre" else now.end_line)()
                pre += 1
            elif tag in SPACED:
                now.gap = True if not now.marks else now.gap
                now.end_line()
            elif tag in BLOCKS:
                now.end_line()
            elif tag == "q":
                now.text('"')
            children = node.children
            if tag == "details" and "open" not in node.attributes:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            todo += [(c, c.__class__ is str and tag) for c in reversed(children)] if tag not in VOID else []
            if tag in ("pre", "textarea") and node.children and isinstance(node.children[0], str) and node.children[0].startswith("\n"):
                todo[-1] = (node.children[0][1:], tag)
            continue
        if node.attributes and "visibility" in styled(node):
            mute.pop()
        svg -= tag == "svg"
        svg_text -= tag in _DRAWN
        if tag == "table":
            made = tables.pop().lay_out()
            now.blank()
            now.kept(made)
            now.blank()
        elif tag in ("td", "th") and tables:
            tables[-1].cell(canvas.pop().done(), max(1, _span(node, "colspan", 1000)), _span(node, "rowspan", 65534))
        elif tag in ("tbody", "thead", "tfoot") and tables:
            tables[-1].down.clear()  # cells don't reach out of their group
        elif tag in LISTS:
            counters.pop()
            (now.end_line if counters else now.blank)()
        elif tag == "li":
            now.end_line()
            if now.marks:
                now.marks.pop()
        elif tag in ("pre", "textarea"):
            pre -= 1
            (now.blank if tag == "pre" else now.end_line)()
        elif tag in SPACED and tag != "hr":
            now.end_line()
            now.gap = True if not now.marks else now.gap
        elif tag in BLOCKS:
            now.end_line()
        elif tag == "q":
            now.text('"')
    return "\n".join(page.done())


#: Elements of drawings whose text shows.
_DRAWN = frozenset({"text", "foreignobject"})


def _between_cells(parent) -> bool:
    """White space between rows and cells isn't text."""
    return parent in ("table", "tbody", "thead", "tfoot", "tr")


def _number(text: str | None) -> int:
    try:
        return int(text) if text is not None else 1
    except ValueError:
        return 1


def _span(node: Node, name: str, most: int) -> int:
    """Columns or rows of a cell; 0 rows are all that are left of the group."""
    found = re.match(r"[ \t\n\r\f]*\+?([0-9]{1,9})", node.attributes.get(name, ""))
    return min(int(found[1]), most) if found else 1


def text_of(html: str | None) -> str:
    return render(tree(html)) if html else ""


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",), text: str = "text") -> DataFrame:
    """``keep`` and the visible text of every row; one pass, no shuffle."""
    common.ship(pages.sparkSession)
    column = common.free("__html", keep)
    source = pages.select(*keep, F.col(html).alias(column))
    out = T.StructType([*[f for f in pages.select(*keep).schema.fields], T.StructField(text, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw in common.chunks(batches, column):
            made = [text_of(h.decode()) if h else "" for h in raw]
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(made, pa.string())], names=out.names)

    return source.mapInArrow(run, out)
