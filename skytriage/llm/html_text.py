"""Visible text of web pages with its layout (operator 4).

A tag reader feeds a tree builder that closes what HTML lets authors leave open; visibility
rules drop what a browser would not show; a renderer writes the rest as lines: paragraphs
apart by a blank line, list items marked and indented, table cells in aligned columns,
preformatted text as it is.
"""

from __future__ import annotations

import html
import re
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lists, quotes, cells and preformatted blocks inside each other that are laid out each on its own. Those
#: deeper keep all their text, lines and marks, without more indentation or columns.
MAX_NEST = 120

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
TEXT_ONLY = frozenset("textarea title".split())
HIDDEN = frozenset("head script style template noscript title meta link base datalist iframe noembed noframes param source track area object video audio canvas rp".split())
HEAD_ONLY = frozenset("title meta link base style script noscript template".split())
#: Blocks with a margin (a blank line around them) and blocks without.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr fieldset menu dir listing plaintext xmp".split())
PLAIN_BLOCK = frozenset("html body div section article aside header footer nav main address form center details summary dialog li dt dd figcaption legend caption optgroup option hgroup search tr thead tbody tfoot".split())
BLOCK = SPACED | PLAIN_BLOCK
#: Start tags that end an open paragraph.
ENDS_P = (SPACED | frozenset("address article aside center details dialog div fieldset figcaption footer form header hgroup main nav section summary search dd dt li".split())) - {"xmp"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tag: open elements it ends, and the elements beyond which it does not look.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table td th body".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset("dl table td th body".split())),
    "dd": (frozenset(["dt", "dd"]), frozenset("dl table td th body".split())),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup body".split())),
    "optgroup": (frozenset("option optgroup".split()), frozenset("select body".split())),
    "a": (frozenset(["a"]), frozenset("td th table body".split())),
    "button": (frozenset(["button"]), frozenset("td th table body".split())),
}
#: Start tags that mean nothing where no table is open.
TABLE_PARTS = frozenset("caption colgroup col thead tbody tfoot tr td th".split())
#: Open elements whose children are rows and cells only: other text and elements go in front of the table.
TABLE_INNER = frozenset("table thead tbody tfoot tr".split())
#: What stays inside a table without being seen.
TABLE_UNSEEN = frozenset("style script template".split())
#: Table part: the open elements it may be a child of.
TABLE_PLACE = {t: frozenset(["table"]) for t in TABLE_PARTS} | {"col": frozenset("table colgroup".split()), "tr": frozenset("table thead tbody tfoot".split())} | {t: TABLE_INNER for t in ("td", "th")}
#: An end tag does not reach out of these.
SCOPE = frozenset("table td th caption html body template".split())
#: End tags that reach out of cells and captions, though not out of a table.
TABLE_ENDS = frozenset("table tr tbody thead tfoot td th caption".split())

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</?([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|</[^A-Za-z][^>]*>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
#: Values of the two properties that count, as words; a declaration with anything else is dropped, as browsers do.
DISPLAY = re.compile(r"(?:none|contents|block|inline|flow|flow-root|flex|grid|table|ruby|list-item|run-in|inline-(?:block|flex|grid|table)|table-[a-z-]+|ruby-[a-z]+|inherit|initial|unset|revert|revert-layer)(?: [a-z-]+)*")
VISIBILITY = re.compile(r"hidden|collapse|visible|inherit|initial|unset|revert|revert-layer")
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.kids = tag, attrs, []


def _attributes(text: str) -> dict[str, str] | None:
    if not text or text.isspace():
        return None
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


class Tree:
    """Builds the tree; ``body`` holds everything that is not in the head."""

    def __init__(self):
        self.head, self.body = Node("head"), Node("body")
        self.stack = [self.body]
        #: Places on the stack by tag, so that no lookup goes through a deep stack.
        self.places: dict[str, list[int]] = {}
        self.in_head = True

    def _nearest(self, *tags: str) -> int:
        """Place of the innermost open element with one of the tags, 0 if there is none."""
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=0)

    def _open(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def _cut(self, k: int) -> None:
        """End the open elements from place ``k`` on."""
        while len(self.stack) > k:
            self.places[self.stack.pop().tag].pop()

    def text(self, data: str) -> None:
        if data:
            if not data.isspace():
                self._leave_columns()
            if self.stack[-1].tag in TABLE_INNER and not data.isspace():
                self._before_table(data)
            else:
                self.stack[-1].kids.append(data)

    def _table(self) -> int:
        """Place of the innermost open table on the stack, 0 if none is open or a template lies in between."""
        k = self._nearest("table")
        return k if k > self._nearest("template") else 0

    def _before_table(self, kid: Node | str) -> None:
        """Put what may not be a child of a table or row in front of the table, which is its parent's last child."""
        kids = self.stack[self._table() - 1].kids
        kids.insert(len(kids) - 1, kid)

    def _leave_columns(self) -> None:
        if self.stack[-1].tag == "colgroup":
            self._cut(len(self.stack) - 1)

    def _close(self, names: frozenset, until: frozenset) -> None:
        """End the innermost open element of ``names`` that is not outside ``until``, and all inside it."""
        k = self._nearest(*names)
        if k > self._nearest(*until):
            self._cut(k)

    def start(self, tag: str, attrs: dict | None) -> None:
        stack = self.stack
        if tag in ("html", "head", "frameset"):
            return
        if tag == "body":
            if attrs:
                self.body.attrs = {**attrs, **(self.body.attrs or {})}
            self.in_head = False
            return
        if tag in TABLE_PARTS:
            # What is open above the place of a part ends, a part without a table is ignored.
            k = self._table()
            if not k:
                return
            self._cut(self._nearest(*TABLE_PLACE[tag]) + 1)
        elif tag not in TABLE_UNSEEN:
            self._leave_columns()
        if tag == "table" and (k := self._table()) > self._nearest("td", "th", "caption"):
            self._cut(k)
        if tag == "form" and stack[-1].tag in TABLE_INNER:
            return  # the rows after it stay rows of the table
        if tag not in HEAD_ONLY:
            self.in_head = False
        if tag in ENDS_P:
            k = self._nearest("p")
            if k and k > self._nearest("button", *SCOPE):
                self._cut(k)
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            self._cut(len(stack) - 1)
        if tag in ENDS:
            self._close(*ENDS[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push("tr", None)
        if tag == "tr" and stack[-1].tag == "table":
            self._push("tbody", None)
        self._push(tag, attrs)

    def _push(self, tag: str, attrs: dict | None) -> None:
        node = Node(tag, attrs)
        if self.stack[-1].tag in TABLE_INNER and tag not in TABLE_PARTS and tag not in TABLE_UNSEEN:
            self._before_table(node)
        else:
            (self.head if self.in_head and tag in HEAD_ONLY else self.stack[-1]).kids.append(node)
        if tag not in VOID:
            self._open(node)

    def end(self, tag: str) -> None:
        if tag in ("html", "body", "head"):
            return
        if tag == "br":
            return self.start("br", None)
        k = self._nearest(*(HEADINGS if tag in HEADINGS else (tag,)))
        if k and k >= self._nearest(*(("table",) if tag in TABLE_ENDS else SCOPE)):
            return self._cut(k)
        if tag == "p":
            self._push("p", None)
            self._cut(len(self.stack) - 1)
        return None


def parse(page: str) -> Node:
    """The body of a page."""
    tree, at, size = Tree(), 0, len(page)
    find = _TOKEN.search
    while at < size:
        m = find(page, at)
        if m is None:
            tree.text(html.unescape(page[at:]))
            break
        if m.start() > at:
            data = page[at: m.start()]
            tree.text(html.unescape(data) if "&" in data else data)
        at = m.end()
        name = m.group(1)
        if name is None:
            continue
        name = name.lower()
        if page[m.start() + 1] == "/":
            tree.end(name)
            continue
        rest = m.group(2)
        tree.start(name, _attributes(rest) if rest else None)
        if name in RAW or name in TEXT_ONLY:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            data = page[at: close.start() if close else size]
            if name == "textarea" and data.startswith("\n"):
                data = data[1:]
            tree.text(html.unescape(data) if name in TEXT_ONLY else data)
            at = close.end() if close else size
            tree.end(name)
    return tree.body


def declared(style: str) -> tuple[str | None, str | None]:
    """What a style attribute says of ``display`` and ``visibility``: the last valid declaration, ``!important`` ones first."""
    found: dict[str, tuple[bool, str]] = {}
    for part in _COMMENT.sub(" ", style).split(";"):
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), " ".join(value.lower().split())
        if not colon or name not in ("display", "visibility"):
            continue
        word, mark, after = value.partition("!")
        word, important = word.strip(), bool(mark)
        if important and after.strip() != "important" or not (DISPLAY if name == "display" else VISIBILITY).fullmatch(word):
            continue
        if important or not found.get(name, (False, ""))[0]:
            found[name] = (important, word)
    return tuple(found[p][1] if p in found else None for p in ("display", "visibility"))


def _shown(node: Node, visible: bool) -> tuple[bool, bool]:
    """Whether an element takes part at all, and whether its own text can be seen.

    The style attribute is heard before ``hidden`` and ``dialog``; style sheets are not read.
    """
    if node.tag in HIDDEN:
        return False, False
    attrs = node.attrs or {}
    display, visibility = declared(attrs["style"]) if attrs.get("style") else (None, None)
    if visibility not in (None, "inherit", "unset"):
        visible = visibility not in ("hidden", "collapse")
    if display is not None and not display.startswith("revert"):
        return display != "none", visible
    if "hidden" in attrs and attrs["hidden"].lower() != "until-found":
        return False, False
    if node.tag == "dialog" and "open" not in attrs:
        return False, False
    return True, visible


class Lines:
    """Lines under construction: inline text joins the open line, blocks end it."""

    def __init__(self):
        self.done: list[str] = []
        self.open = ""
        self.gap = False
        self.mark = ""

    def inline(self, data: str) -> None:
        data = _SPACE.sub(" ", data)
        if not self.open or self.open.endswith((" ", "\n")):
            data = data.lstrip(" ")
        self.open += data

    def flush(self) -> None:
        line = self.open.rstrip(" ")
        line = line[:-1].rstrip(" ") if line.endswith("\n") else line  # a break at the end of a block adds no line
        if line:
            self.put([self.mark + x if k == 0 else " " * len(self.mark) + x for k, x in enumerate(line.split("\n"))])
            self.mark = ""
        self.open = ""

    def put(self, lines: list[str]) -> None:
        if self.gap and self.done:
            self.done.append("")
        self.gap = False
        self.done.extend(lines)

    def space(self) -> None:
        self.flush()
        self.gap = True


def drive(task: Generator) -> object:
    """Result of a task that yields the tasks it waits for; a list takes the place of the call stack, so depth has no limit."""
    waiting, value = [task], None
    while waiting:
        try:
            task = waiting[-1].send(value)
        except StopIteration as end:
            waiting.pop()
            value = end.value
        else:
            waiting.append(task)
            value = None
    return value


def render(node: Node, out: Lines, visible: bool = True, pre: bool = False, depth: int = 0, nest: int = 0) -> Generator:
    """Task that adds the lines of an element; ``depth`` counts lists, ``nest`` all that has lines of its own."""
    flat = nest >= MAX_NEST
    numbers = _numbers(node) if node.tag == "ol" else None
    for kid in node.kids:
        if isinstance(kid, str):
            if visible:
                out.open = out.open + kid if pre else out.open
                if not pre:
                    out.inline(kid)
            continue
        there, seen = _shown(kid, visible)
        if not there:
            continue
        tag = kid.tag
        if tag == "br":
            out.open = out.open.rstrip(" ") + "\n"
        elif tag == "hr":
            out.space()
        elif tag == "table":
            out.space()
            if flat:
                yield render(kid, out, seen, False, 0, nest)
                out.space()
                continue
            rows = yield table(kid, seen, nest + 1)
            if rows:
                out.put([out.mark + rows[0], *(" " * len(out.mark) + r for r in rows[1:])])
                out.mark = ""
            out.gap = True
        elif flat and tag in ("td", "th"):
            out.inline(" ")
            yield render(kid, out, seen, pre, 0, nest)
            out.inline(" ")
        elif flat and tag == "li":
            out.flush()
            before, lines = out.mark, len(out.done)
            out.mark = before + (f"{numbers[id(kid)]}. " if numbers else "- ")
            yield render(kid, out, seen, pre, depth + 1, nest)
            out.flush()
            out.mark = before if len(out.done) == lines else ""
        elif flat and tag in ("pre", "listing", "xmp", "plaintext", "blockquote", "dd", "ul", "ol", "menu", "dir", "dl"):
            out.flush()
            out.gap = out.gap or tag in ("pre", "listing", "xmp", "plaintext", "blockquote")
            yield render(kid, out, seen, pre or tag in ("pre", "listing", "xmp", "plaintext"), depth, nest)
            out.flush()
        elif tag in ("pre", "listing", "xmp", "plaintext"):
            out.space()
            inner = Lines()
            yield render(kid, inner, seen, True, depth, nest + 1)
            text = inner.open[1:] if inner.open.startswith("\n") else inner.open
            lines = [*inner.done, *text.rstrip("\n").split("\n")] if text.strip() else inner.done
            if lines:
                out.put(lines)
            out.gap = True
        elif tag == "li":
            out.flush()
            inner = Lines()
            yield render(kid, inner, seen, pre, depth + 1, nest + 1)
            inner.flush()
            mark = f"{numbers[id(kid)]}. " if numbers else "- "
            if inner.done:
                out.put([mark + inner.done[0], *(" " * len(mark) + x if x else x for x in inner.done[1:])])
        elif tag in ("ul", "ol", "menu", "dir", "dl"):
            (out.flush if depth else out.space)()
            inner = Lines()
            yield render(kid, inner, seen, pre, depth + 1, nest + 1)
            inner.flush()
            if inner.done:
                out.put(inner.done)
            out.gap = out.gap or not depth
        elif tag == "blockquote":
            out.space()
            inner = Lines()
            yield render(kid, inner, seen, pre, depth, nest + 1)
            inner.flush()
            out.put(["  " + x if x else x for x in inner.done])
            out.gap = True
        elif tag == "input":
            kind = (kid.attrs or {}).get("type", "text").lower()
            if seen and kind in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number"):
                out.inline(" " + (kid.attrs or {}).get("value", "") + " ")
        elif tag == "dd":
            out.flush()
            inner = Lines()
            yield render(kid, inner, seen, pre, depth, nest + 1)
            inner.flush()
            if inner.done:
                out.put(["  " + x if x else x for x in inner.done])
        elif tag in SPACED:
            out.space()
            yield render(kid, out, seen, pre, depth, nest)
            out.space()
        elif tag in PLAIN_BLOCK:
            out.flush()
            yield render(kid, out, seen, pre, depth, nest)
            out.flush()
        elif tag == "q":
            out.inline('"') if seen else None
            yield render(kid, out, seen, pre, depth, nest)
            out.open += '"' if seen else ""
        else:
            yield render(kid, out, seen, pre, depth, nest)


def _integer(text: str | None, default: int) -> int:
    m = re.match(r"\s*(-?\d{1,6})", text or "")
    return int(m.group(1)) if m else default


def _numbers(node: Node) -> dict[int, int]:
    items = [k for k in node.kids if isinstance(k, Node) and k.tag == "li"]
    attrs = node.attrs or {}
    step = -1 if "reversed" in attrs else 1
    n = _integer(attrs.get("start"), len(items) if step < 0 else 1)
    out = {}
    for k in items:
        n = _integer((k.attrs or {}).get("value"), n)
        out[id(k)] = n
        n += step
    return out


def _rows(node: Node, visible: bool, foot: bool) -> Iterator[tuple[Node, bool]]:
    """Rows of a table that are shown; those of its first foot, which stands below all others, are a call of their own."""
    footed = False
    for kid in node.kids:
        if not isinstance(kid, Node):
            continue
        there, seen = _shown(kid, visible)
        if not there:
            continue
        if kid.tag == "tr" and not foot:
            yield kid, seen
        elif kid.tag in ("thead", "tbody", "tfoot"):
            below, footed = kid.tag == "tfoot" and not footed, footed or kid.tag == "tfoot"
            if below == foot:
                yield from _rows(kid, seen, False)


def table(node: Node, visible: bool, nest: int) -> Generator:
    """Task that gives the lines of a table: captions first, then rows with columns as wide as their widest cell, two spaces apart."""
    lines: list[str] = []
    for kid in node.kids:
        if isinstance(kid, Node) and kid.tag == "caption":
            there, seen = _shown(kid, visible)
            if there:
                inner = Lines()
                yield render(kid, inner, seen, nest=nest)
                inner.flush()
                lines += inner.done
    grid: list[dict[int, tuple[list[str], int]]] = []
    taken: dict[int, int] = {}
    for row, seen in [*_rows(node, visible, False), *_rows(node, visible, True)]:
        cells: dict[int, tuple[list[str], int]] = {}
        at = 0
        for cell in row.kids:
            if not isinstance(cell, Node) or cell.tag not in ("td", "th"):
                continue
            there, own = _shown(cell, seen)
            if not there:
                continue
            while taken.get(at, 0) > 0:
                at += 1
            attrs = cell.attrs or {}
            wide, high = min(max(_integer(attrs.get("colspan"), 1), 1), 1000), min(max(_integer(attrs.get("rowspan"), 1), 1), 65534)
            inner = Lines()
            yield render(cell, inner, own, nest=nest)
            inner.flush()
            cells[at] = (inner.done, wide)
            for k in range(at, at + wide):
                taken[k] = high
            at += wide
        grid.append(cells)
        taken = {k: n - 1 for k, n in taken.items() if n > 1}
    width: dict[int, int] = {}
    for cells in grid:
        for at, (text, wide) in cells.items():
            if wide == 1:
                width[at] = max(width.get(at, 0), max(map(len, text), default=0))
    for cells in grid:
        for at, (text, wide) in cells.items():
            need = max(map(len, text), default=0) - sum(width.get(k, 0) for k in range(at, at + wide)) - 2 * (wide - 1)
            if wide > 1 and need > 0:
                width[at + wide - 1] = width.get(at + wide - 1, 0) + need
    start, x = {}, 0
    for k in range(max(width, default=-1) + 1):
        start[k] = x
        x += width.get(k, 0) + 2 if width.get(k, 0) else 0
    for cells in grid:
        for n in range(max((len(t) for t, _ in cells.values()), default=0)):
            line = ""
            for at, (text, _) in sorted(cells.items()):
                if n < len(text) and text[n]:
                    line = line.ljust(start.get(at, 0)) + text[n]
            lines.append(line)
    return lines


def visible_text(page: str | None) -> str:
    """Visible text of a page, lines separated by newlines; empty for null and for pages that show nothing."""
    if not page:
        return ""
    body = parse(page.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "�"))
    there, seen = _shown(body, True)
    out = Lines()
    if there:
        drive(render(body, out, seen))
        out.flush()
    return "\n".join(x.rstrip() for x in out.done).strip("\n")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: ``page_id, text, n_lines``.

    Null and empty pages give an empty text of 0 lines. Repeated rows and null ids keep
    their rows; other columns are not read.
    """
    picked = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(h.as_py()) for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int32())], names=["page_id", "text", "n_lines"])

    return picked.mapInArrow(run, f"page_id {dict(picked.dtypes)['page_id']}, text string, n_lines int")
