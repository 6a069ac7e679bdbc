"""HTML to text as it is laid out: a tree builder with implied tags, rendered as it goes.

One pass keeps the stack of open elements, opening and closing those that the page leaves out, and
writes visible text to a canvas: blocks on lines of their own with blank lines around paragraphs,
list items behind bullets or numbers, table cells in aligned columns. Text is visible unless an open
element hides it: by kind, `hidden` or display none, with all that is in it, or by visibility, until an
element in it is made visible again. A tag that never ends swallows the rest, as in browsers.

Time and text grow in proportion to the page however deep it nests: nothing recurses or looks through the
open elements; tables within MOST_TABLES others have their cells one below the other; a cell keeps its
columns free in the rows below for MOST_HELD cells at a time; and no line of a table has more than
MOST_BEGIN blanks before a cell, so a column that would begin further right isn't aligned.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvox.llm.textbytes import plus

# fixed values of the HTML standard: kinds of elements
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist svg math".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table ul".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
CELLS, LISTS, GROUPS = ("td", "th", "caption"), ("ul", "ol", "menu", "dir"), ("thead", "tbody", "tfoot")
#: What an opening tag closes, and where looking for it stops.
ENDS = {
    "li": (("li",), (*LISTS, "table", *CELLS)), "dt": (("dt", "dd"), ("dl", "table", *CELLS)), "dd": (("dt", "dd"), ("dl", "table", *CELLS)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "tr": (("tr", "caption"), ("table",)),
    "thead": ((*GROUPS, "tr", "caption"), ("table",)), "tbody": ((*GROUPS, "tr", "caption"), ("table",)), "tfoot": ((*GROUPS, "tr", "caption"), ("table",)),
    "body": (("head",), ()),
}

#: A tag's name, and the rest of it: quotes count only after an equals sign, and only if they are closed.
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""((?:[^>=]|=\s*(?:"[^"]*"|'[^']*')?)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_SEEN = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)
_CLOSING = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
#: Columns that nested lists and quotes may indent a line by.
MOST_INDENT = 60
#: Tables in one another that are laid out side by side, cells of several rows at a time, and the last aligned column.
MOST_TABLES, MOST_HELD, MOST_BEGIN = 8, 64, 240
_COMMENT_END = re.compile("--!?>")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_HEAD = frozenset("html head title meta link base script style noscript template".split())


def width(text: str) -> int:
    """Columns that text takes: two for wide characters, none for combining ones."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Canvas:
    """Lines of text with the margins between them."""

    def __init__(self):
        self.lines, self.now, self.margin, self.indent, self.bullet, self.ends_blank = [], [], 0, 0, "", True

    def write(self, text: str, pre: bool) -> None:
        if pre:
            first, *more = text.replace("\r\n", "\n").replace("\t", "    ").split("\n")
            self._add(first)
            for line in more:
                self.line_break()
                self._add(line)
            return
        text = _SPACES.sub(" ", text)
        if self.ends_blank and text.startswith(" "):
            text = text[1:]
        self._add(text)

    def _add(self, text: str) -> None:
        if text:
            self.now.append(text)
            self.ends_blank = text.endswith(" ")

    def line_break(self) -> None:
        if not self.flush() and self.lines:
            self.lines.append("")

    def flush(self) -> bool:
        line = "".join(self.now).rstrip(" ")
        self.now, self.ends_blank = [], True
        if line:
            self.put([line])
        return bool(line)

    def put(self, lines: list[str]) -> None:
        if self.lines and self.margin and self.lines[-1]:
            self.lines += [""] * self.margin
        self.margin = 0
        lead = " " * min(self.indent, MOST_INDENT)
        if self.bullet:
            lead = lead[: max(0, len(lead) - len(self.bullet))] + self.bullet
            self.bullet = ""
        for line in lines:
            self.lines.append((lead + line) if line else "")
            lead = " " * min(self.indent, MOST_INDENT)

    def block(self, margin: int) -> None:
        self.flush()
        self.margin = max(self.margin, margin)

    def done(self) -> list[str]:
        self.flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _placed(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[list[str], int, int]]]:
    """The cells of each row as (lines, first column, column after): below a cell of several rows its columns stay free, for MOST_HELD cells at a time."""
    held, out = [], []  # (first column, column after, row after) of such cells
    for r, row in enumerate(rows):
        held, at, k, made = [x for x in held if x[2] > r], 0, 0, []
        taken = sorted(held)
        for lines, span, down in row:
            while k < len(taken) and taken[k][0] <= at:
                at = max(at, taken[k][1])
                k += 1
            made.append((lines, at, at + span))
            if down > 1 and len(held) < MOST_HELD:
                held.append((at, at + span, r + down))
            at += span
        out.append(made)
    return out


def lay_out(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table of cells (lines, columns, rows): side by side, each column as wide as its widest cell of one column.

    Columns begin at MOST_BEGIN at most; a line that is used beyond its cell's column goes on two blanks further.
    """
    placed = _placed(rows)
    # only columns where a cell begins or ends count, however many a cell spans
    edges = sorted({x for row in placed for _, a, z in row for x in (a, z)})
    number = {x: i for i, x in enumerate(edges)}
    widths = [0] * len(edges)
    for row in placed:
        for lines, a, z in row:
            if number[z] == number[a] + 1:
                widths[number[a]] = max([widths[number[a]], *map(width, lines)])
    begin = [0]  # where each column begins, two blanks after the one before
    for w in widths:
        begin.append(min(begin[-1] + w + 2, MOST_BEGIN))
    out = []
    for row in placed:
        beside = [[] for _ in range(max((len(lines) for lines, _, _ in row), default=0))]
        for lines, a, _ in row:
            for i, text in enumerate(lines):
                if text:
                    beside[i].append((begin[number[a]], text))
        for texts in beside:
            line, used = [], 0
            for at, text in texts:
                gap = at - used if used <= at else 2
                own = len(text) - len(text.lstrip(" "))
                gap = max(min(gap, MOST_BEGIN - own), 2 if used else 0)
                line.append(" " * gap + text)
                used += gap + width(text)
            out.append("".join(line).rstrip(" "))
    return out


class Renderer:
    """The open elements, where each kind of them is open, and the canvases of the cells among them."""

    def __init__(self):
        self.open: list[tuple] = []  # (tag, hides, preformatted, unseen before, state); state is False in a hidden element
        self.where: dict[str, list[int]] = {}
        self.lists: list[tuple[str, list]] = []
        self.canvas = [Canvas()]
        self.tables: list[list] = []
        self.gone = self.pre = 0
        self.unseen = False

    # -- the stack --

    def _nearest(self, tags) -> int:
        """Place of the innermost open element of one of tags, -1 if none is open."""
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=-1)

    def _spaced(self, tag: str) -> bool:
        return tag in SPACED and not (tag in LISTS and self.where.get("li"))

    def _push(self, tag: str, attributes: str) -> None:
        hides, before, got = tag in HIDDEN, self.unseen, {}
        if attributes and ("hidden" in (low := attributes.lower()) or "style" in low or tag in ("ol", "li", "td", "th", "dialog")):
            got = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTRIBUTE.finditer(attributes)))}
            style = got.get("style", "")
            hides |= "hidden" in got or bool(_NONE.search(style))
            seen = _SEEN.findall(style)
            self.unseen = seen[-1].lower() != "visible" if seen else self.unseen
        hides |= tag == "dialog" and "open" not in got
        pre = tag in ("pre", "textarea", "xmp")
        self.gone += hides
        self.pre += pre
        state = False if self.gone else self._begin(tag, got)
        self.where.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, hides, pre, before, state))

    def _begin(self, tag: str, got: dict[str, str]):
        """What the beginning of an element does to the canvas; what its end needs to know."""
        state = None
        if tag in BLOCK:
            self.canvas[-1].block(self._spaced(tag))
        c = self.canvas[-1]
        if tag in LISTS:
            start = got.get("start", "")
            self.lists.append((tag, [int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1]))
            state, c.indent = c.indent, c.indent + (2 if tag != "ol" else 4)
        elif tag == "li":
            if self.lists and self.lists[-1][0] == "ol":
                number = self.lists[-1][1]
                if re.fullmatch(r"-?\d{1,9}", got.get("value", "")):
                    number[0] = int(got["value"])
                c.bullet = f"{number[0]}. ".rjust(4)
                number[0] += 1
            else:
                c.bullet = "* "
                if not self.lists:
                    state, c.indent = c.indent, c.indent + 2
        elif tag in ("blockquote", "dd"):
            state, c.indent = c.indent, c.indent + 4
        elif tag == "table":
            self.tables.append([] if len(self.tables) < MOST_TABLES else None)
        elif tag == "tr" and self.tables and self.tables[-1] is not None:
            self.tables[-1].append([])
        elif tag in CELLS and self.tables and self.tables[-1] is None:
            c.block(0)
        elif tag in CELLS:
            span, down = got.get("colspan", ""), got.get("rowspan", "")
            state = (min(int(span), 1000) if re.fullmatch(r"[1-9]\d{0,3}", span) else 1, 65534 if down == "0" else int(down) if re.fullmatch(r"[1-9]\d{0,4}", down) else 1)
            self.canvas.append(Canvas())
        return state

    def _pop(self) -> None:
        tag, hides, pre, before, state = self.open.pop()
        self.where[tag].pop()
        self.gone -= hides
        self.pre -= pre
        self.unseen = before
        if state is False:
            return
        if tag in CELLS and state is None:
            self.canvas[-1].block(0)
        elif tag in CELLS:
            lines = self.canvas.pop().done()
            if tag == "caption":
                self.canvas[-1].block(0)
                self.canvas[-1].put(lines) if lines else None
            elif self.tables and self.tables[-1]:
                self.tables[-1][-1].append((lines, *state))
        elif tag == "table":
            rows = self.tables.pop()
            lines = lay_out(rows) if rows else []
            if any(lines):
                self.canvas[-1].put(lines)
        c = self.canvas[-1]
        if tag in BLOCK:
            c.block(self._spaced(tag))
        if tag in LISTS:
            self.lists.pop()
            c.indent = state
        elif tag in ("blockquote", "dd") or tag == "li":
            c.bullet = ""
            c.indent = c.indent if state is None else state

    def _close(self, tags: tuple, until: tuple) -> None:
        """Close the nearest of tags, if it is nearer than any of until, with all that is open in it."""
        at = self._nearest(tags)
        if at > self._nearest(until):
            while len(self.open) > at:
                self._pop()

    def _inside(self, tag: str, until: tuple) -> bool:
        return self._nearest((tag,)) > self._nearest(until)

    # -- tokens --

    def start(self, tag: str, attributes: str, closed: bool) -> None:
        if tag not in _HEAD and any(t[0] == "head" for t in self.open[:2]):
            self._close(("head",), ())
        if tag in CLOSES_P:
            self._close(("p",), ("table", *CELLS, "button"))
        if tag in ENDS:
            tags, until = ENDS[tag]
            self._close(tags, until)
            if tag in ("tr", *GROUPS):
                while self.open and self.open[-1][0] in tags:
                    self._close(tags, until)
        if tag in ("td", "th"):
            if not self._inside("table", ()):
                return
            if not self._inside("tr", ("table",)):
                self._push("tr", "")
        if tag in ("tr", *GROUPS, "caption") and not self._inside("table", CELLS):
            return
        if tag == "br":
            if not self.gone and not self.unseen:
                self.canvas[-1].line_break()
        elif tag == "hr":
            if not self.gone:
                self.canvas[-1].block(1)
        elif tag not in VOID and not (closed and tag in ("svg", "math")):
            self._push(tag, attributes)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "", False)
        elif tag == "p" and not self._inside("p", ("table", *CELLS, "button")):
            if not self.gone:
                self.canvas[-1].block(1)
        elif tag in ("html", "body"):
            pass
        elif tag in ("table", "tr", *GROUPS, *CELLS):
            self._close((tag,), ("table",) if tag != "table" else ())
        else:
            self._close((tag,), ("table", *CELLS) if tag not in CELLS else ("table",))

    def text(self, raw: str) -> None:
        if self.gone or self.unseen or not raw:
            return
        if self.open and self.open[-1][0] in ("table", "tr", *GROUPS):
            if raw.strip():  # text between cells comes before the table
                self.canvas[-1].write(html.unescape(raw), False)
                self.canvas[-1].block(0)
            return
        self.canvas[-1].write(html.unescape(raw) if "&" in raw else raw, self.pre > 0)


def render(page: str | None) -> str:
    """The visible text of a page; of null, nothing."""
    if not page:
        return ""
    r, at = Renderer(), 0
    page = page.replace("\0", "")
    while at < len(page):
        open_ = page.find("<", at)
        if open_ < 0 or open_ > at:
            r.text(page[at:open_] if open_ > at else page[at:])
            if open_ < 0:
                break
        name = _NAME.match(page, open_)
        if not name:
            at = _other(page, open_)
            if at == open_ + 1:
                r.text("<")
            continue
        rest = _REST.match(page, name.end())
        if not rest:
            break
        at, tag, attributes = rest.end(), name[1].lower(), rest[1]
        if page[open_ + 1] == "/":
            r.end(tag)
            continue
        r.start(tag, attributes, attributes.endswith("/"))
        if tag in RAW and r.open and r.open[-1][0] == tag:
            close = _CLOSING[tag].search(page, at)
            stop, after = (close.start(), close.end()) if close else (len(page), len(page))
            if tag == "textarea":
                r.text(page[at:stop])
            r.end(tag)
            at = after
    while r.open:
        r._pop()
    return "\n".join(r.canvas[0].done())


def _other(page: str, at: int) -> int:
    """The end of a comment, declaration or bogus closing tag at a `<`; just after it if it is none."""
    if page.startswith(("<!-->", "<!--->"), at):
        return page.index(">", at) + 1
    if page.startswith("<!--", at):
        end = _COMMENT_END.search(page, at + 4)
        return end.end() if end else len(page)
    if page.startswith(("<!", "<?"), at) or (page.startswith("</", at) and len(page) > at + 2):
        end = page.find(">", at)
        return end + 1 if end >= 0 else len(page)
    return at + 1


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """pages with html replaced by text.

    Null and empty pages give an empty text; other columns stay, one named `text` gives way to the result. Rows are
    rendered one by one, so repeated rows give repeated results, an empty table an empty one, and a page of any
    length is rendered whole.
    """
    rest = [c for c in pages.columns if c not in (html_column, "text")]

    def run(batches):
        for batch in batches:
            made = [render(x) for x in batch.column(batch.schema.get_field_index(html_column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in rest), pa.array(made, pa.string())], [*rest, "text"])

    own = pages.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{html_column}`"))
    return own.mapInArrow(run, plus(own.select(*[F.col(f"`{c}`") for c in rest]).schema, ("text", "string")))
