"""Operator 1, HTML extraction: a layout-aware rendering of pages to text.

A tree builder reads tags, text, comments and raw-text elements, opens the implied html,
head and body, closes elements that a new tag implies to be closed (a paragraph before a
block, a list item before the next, table parts) and ignores end tags without a match and
table parts without a table. What a table can't hold goes before it. For each name it
keeps where the open elements of that name are, so that a tag costs the same however many
are open. Rendering walks the visible tree: elements that never show, the attribute
hidden, and the inline style display: none hide their content, a closed details element
all but its summary; visibility: hidden is inherited until an element inside is visible.
Blocks stand on lines of their own, paragraphs and headings apart by an empty line; list
items have bullets or numbers and are indented by depth; cells of a table are aligned in
columns by display width; pre keeps its spaces. Of a drop-down list the chosen option
shows, of a list with several rows all options; of an input of text, its value; of
formulas the text, without annotations; of drawings their text elements. Style sheets
don't count, only inline styles.

Null or empty html: empty text. Ill-formed markup, such as an unclosed tag, still gives a
text. Deep nesting is walked without recursion. Repeated rows give equal rows, a null
page_id is carried, an empty table gives an empty result, other columns are left out.
Long pages are handled one at a time.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import arrow_map, pick, strings, table

# Names of elements (fixed values, from the HTML standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes plaintext".split())
ESCAPABLE = frozenset("textarea title".split())
HEAD = frozenset("base link meta title style script template noscript".split())
NEVER_SHOWN = frozenset("head script style template noscript title iframe object video audio canvas datalist noembed noframes area param rp annotation annotation-xml desc metadata defs".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol p pre search section summary table ul".split())
APART = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu".split())
ENDS_P = BLOCK - frozenset("body html legend li dd dt".split()) | {"li", "dd", "dt"}
SECTIONS = frozenset("thead tbody tfoot".split())
#: What may stand in a table outside its cells, and inputs that show their value.
IN_TABLE = SECTIONS | frozenset("caption colgroup col tr td th script style template".split())
VALUED = frozenset("text search url tel email number date month week time datetime-local submit button reset".split())
#: The most columns and rows that a cell spans.
MOST_WIDE, MOST_HIGH = 1000, 65534
_TABLE, _CELLS = frozenset(("table",)), frozenset(("table", "td", "th", "caption"))

_TOKEN = re.compile(
    r"<!--(?:>|->|(?P<comment>.*?)(?:-->|--!>|\Z))"
    r"|<(?P<bogus>[!?][^>]*)>?"
    r"|<(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?P<close>>)"
    r"|<(?P<dangling>/?[a-zA-Z][^>]*\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDING = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!important\s*)?(?:;|$)", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse|initial|inherit|unset|revert)\s*(!important\s*)?(?=;|$)", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []


class Stack:
    """The open elements; the first two are html and body. at: where those of each name are."""

    def __init__(self, root: Node):
        self.open = [root]
        self.at: dict[str, list[int]] = {}

    def top(self) -> Node:
        return self.open[-1]

    def push(self, n: Node) -> None:
        self.at.setdefault(n.name, []).append(len(self.open))
        self.open.append(n)

    def cut(self, size: int) -> None:
        """Close all but the first size elements."""
        while len(self.open) > size:
            self.at[self.open.pop().name].pop()

    def nearest(self, names: Iterable[str]) -> int:
        """Where the nearest open element of names is, 0 if there is none."""
        return max((x[-1] for n in names if (x := self.at.get(n))), default=0)

    def close(self, names: Iterable[str], stop: Iterable[str] = ()) -> bool:
        """Close the nearest open element of names, unless one of stop is nearer."""
        k = self.nearest(names)
        if not k or k < self.nearest(stop):
            return False
        self.cut(k)
        return True

    def clear(self, names: Iterable[str]) -> None:
        """Close what is open in the nearest element of names."""
        self.cut(self.nearest(names) + 1)


def parse(html: str) -> Node:
    """The tree below an html element; children are nodes and strings."""
    root = Node("html", {})
    head, body = Node("head", {}), Node("body", {})
    root.children = [head, body]
    stack = Stack(root)
    in_body = False

    def enter_body() -> None:
        nonlocal in_body
        if not in_body:
            in_body = True
            stack.open = [root, body]

    def place(x: Node | str) -> None:
        """Append to what is open; before the table, if that is a table outside its cells."""
        on = stack.top()
        if on.name not in ("table", "tr", *SECTIONS) or (x.strip(" \t\n\r\f") == "" if isinstance(x, str) else x.name in IN_TABLE or (x.name == "input" and x.attrs.get("type", "").lower() == "hidden")):
            on.children.append(x)
            return
        k = stack.nearest(_TABLE)
        if not k:
            on.children.append(x)
            return
        around, before = stack.open[k - 1].children, stack.open[k]
        # an open table is the last child, but for what this put before it
        around.insert(len(around) - 1 if around and around[-1] is before else len(around), x)

    def text(s: str) -> None:
        if s:
            if not in_body:
                if not s.strip(" \t\n\r\f"):
                    return
                enter_body()
            place(s)

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if not m:
            text(unescape(html[at:]))
            break
        if m.start() > at:
            text(unescape(html[at : m.start()]))
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if m["end"]:
            if name in ("html", "body", "head"):
                if name == "head":
                    enter_body()
            elif name == "br":
                enter_body()
                place(Node("br", {}))
            elif name == "p":
                enter_body()
                if not stack.close(("p",), _CELLS):
                    place(Node("p", {}))
            elif name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                stack.close(("h1", "h2", "h3", "h4", "h5", "h6"), ("table", "td", "th"))
            elif name in ("table", "tr", "td", "th", "caption", "thead", "tbody", "tfoot"):
                stack.close((name,), () if name == "table" else _TABLE)
            else:
                stack.close((name,), _CELLS)
            continue
        attrs: dict[str, str] = {}
        raw = m["attrs"].strip()
        if raw:
            for a in _ATTR.finditer(raw):
                attrs.setdefault(a[1].lower(), unescape(a[2] or a[3] or a[4] or ""))
        if name in ("html", "body", "head"):
            node = {"html": root, "body": body, "head": head}[name]
            node.attrs = attrs | node.attrs
            if name == "body":
                enter_body()
            continue
        node = Node(name, attrs)
        foreign = bool(stack.nearest(("svg", "math"))) or name in ("svg", "math")
        if not in_body and name in HEAD:
            head.children.append(node)
        else:
            enter_body()
            if name in ENDS_P:
                stack.close(("p",), ("button", *_CELLS))
            if name == "li":
                stack.close(("li",), ("ul", "ol", "menu", "dir", *_CELLS))
            elif name in ("dt", "dd"):
                stack.close(("dt", "dd"), ("dl", *_CELLS))
            elif name in ("option", "optgroup"):
                stack.close(("option",) if name == "option" else ("option", "optgroup"), ("select", "datalist"))
            elif name in ("td", "th", "tr", "caption", "colgroup", "col", *SECTIONS):
                if not stack.nearest(_TABLE):
                    continue
                stack.clear(("table", "tr", *SECTIONS) if name in ("td", "th") else ("table", *SECTIONS) if name == "tr" else ("table", "colgroup") if name == "col" else _TABLE)
            elif re.fullmatch("h[1-6]", name) and re.fullmatch("h[1-6]", stack.top().name):
                stack.cut(len(stack.open) - 1)
            if name in ("td", "th") and stack.top().name in ("table", *SECTIONS):
                row = Node("tr", {})
                place(row)
                stack.push(row)
            place(node)
            if name not in VOID and name not in RAW and name not in ESCAPABLE and not (foreign and raw.endswith("/")):
                stack.push(node)
        if name in RAW or name in ESCAPABLE or (name in ("template", "noscript") and not in_body):
            close = re.compile(f"</{name}(?=[\\s/>])[^>]*>?|</{name}\\Z", re.I).search(html, at)
            inner = html[at : close.start() if close else size]
            node.children.append(unescape(inner) if name in ESCAPABLE else inner)
            at = close.end() if close else size
    return root


def hidden(n: Node) -> bool:
    return n.name in NEVER_SHOWN or "hidden" in n.attrs or (n.name == "input" and n.attrs.get("type", "").lower() == "hidden") or (n.name == "dialog" and "open" not in n.attrs) or bool("style" in n.attrs and _HIDING.search(n.attrs["style"]))


def visibility(n: Node, inherited: str) -> str:
    """The last value of the style, an important one before others; visible, hidden or collapse."""
    found = _VISIBILITY.findall(n.attrs["style"]) if "style" in n.attrs else []
    if not found:
        return inherited
    value = max(enumerate(found), key=lambda x: (bool(x[1][1]), x[0]))[1][0].lower()
    return "visible" if value == "initial" else inherited if value in ("inherit", "unset", "revert") else value


def _options(n: Node) -> list[str]:
    """What shows of a select: of a drop-down the chosen option, else the first; of a list all options."""
    found: list[Node] = []
    todo = list(reversed(n.children))
    while todo:
        x = todo.pop()
        if isinstance(x, Node) and not hidden(x):
            if x.name == "option":
                found.append(x)
            else:
                todo.extend(reversed(x.children))
    several = "multiple" in n.attrs or (re.fullmatch(r"\d{1,9}", rows := n.attrs.get("size", "")) and int(rows) > 1)
    if not several:
        chosen = [x for x in found if "selected" in x.attrs][-1:]
        found = chosen or [x for x in found if "disabled" not in x.attrs][:1] or found[:1]
    labels = (x.attrs.get("label") or "".join(c for c in x.children if isinstance(c, str)) for x in found)
    return [y for x in labels if (y := x.strip(" \t\n\r\f"))]


def _drawn(n: Node) -> list[Node | str]:
    """The text elements of a drawing, a space between them, and foreign content."""
    out: list[Node | str] = []
    todo = list(reversed(n.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str) or hidden(x):
            continue
        if x.name in ("text", "foreignobject"):
            out += [" ", x, " "]
        else:
            todo.extend(reversed(x.children))
    return out


def width(s: str) -> int:
    """Columns that a text takes: wide characters two, combining marks none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Page:
    """Lines of text; a gap asks for empty lines before what comes next."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0
        self.indent: list[int] = []
        self.mark = ""

    def word(self, s: str, keep: bool = False) -> None:
        if keep:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self._put(first)
            for x in rest:
                self.close(force=True)
                self._put(x)
            return
        lead, trail = s[0] in " \t\n\r\f", s[-1] in " \t\n\r\f"
        body = _SPACES.sub(" ", s).strip(" ")
        self.space |= lead
        if body:
            self._put((" " if self.space and self.line else "") + body)
            self.space = trail
        else:
            self.space |= trail

    def _put(self, s: str) -> None:
        if not s:
            return
        if not self.line:
            if self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            pad = " " * sum(self.indent)
            self.line.append(pad[: max(0, len(pad) - len(self.mark))] + self.mark if self.mark else pad)
            self.mark = ""
        self.line.append(s)

    def close(self, force: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        elif force and self.lines:
            self.lines.append("")
        self.space = False

    def apart(self, gap: int) -> None:
        self.close()
        self.gap = max(self.gap, gap)

    def text(self) -> str:
        self.close()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines)


def render(top: Node) -> str:
    """The visible text of a tree."""
    page = Page()
    # (node, None) enters, (None, action) leaves
    todo: list = [top]
    pages = [page]
    lists: list[list] = []
    pre = [0]
    seen = ["visible"]

    def later(f) -> None:
        todo.append(f)

    while todo:
        n = todo.pop()
        if callable(n):
            n()
            continue
        page = pages[-1]
        if isinstance(n, str):
            if n and seen[-1] == "visible":
                page.word(n, bool(pre[-1]))
            continue
        if hidden(n):
            continue
        name = n.name
        children = n.children
        state = visibility(n, seen[-1])
        shown = state == "visible"
        if name == "details" and "open" not in n.attrs:
            children = [c for c in children if isinstance(c, Node) and c.name == "summary"][:1]
        if name == "br":
            page.close(force=shown and not page.line)
            continue
        if name == "hr":
            page.apart(1)
            page.gap = 1
            continue
        if name == "img":
            if shown and (alt := n.attrs.get("alt", "").strip()):
                page.word(f" {alt} ")
            continue
        if name == "input":
            if shown and (n.attrs.get("type", "").lower() or "text") in VALUED and n.attrs.get("value"):
                page.word(f" {n.attrs['value']} ")
            continue
        if name == "select":
            for label in _options(n):
                if shown:
                    page.word(f" {label} ")
            continue
        if name == "svg":
            children = _drawn(n)
        if name == "table":
            seen.append(state)
            later(seen.pop)
            _table(n, pages, later, todo, seen)
            continue
        block, gap = name in BLOCK, 1 if name in APART and not (lists and name in ("ul", "ol", "menu")) else 0
        if block:
            page.apart(gap)
        leave = []
        if state != seen[-1]:
            seen.append(state)
            leave.append(seen.pop)
        if name in ("ul", "ol", "menu", "dir"):
            start = n.attrs.get("start", "")
            lists.append([name == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            page.indent.append(0)
            leave += [lists.pop, page.indent.pop]
        elif name == "li":
            ordered = lists[-1] if lists else [False, 1]
            value = n.attrs.get("value", "")
            if ordered[0] and re.fullmatch(r"-?\d{1,9}", value):
                ordered[1] = int(value)
            mark = f"{ordered[1]}. " if ordered[0] else "- "
            ordered[1] += 1
            page.indent.append(len(mark))
            page.mark = mark if shown else ""
            leave += [lambda p=page: setattr(p, "mark", ""), page.indent.pop]
        elif name in ("blockquote", "dd"):
            page.indent.append(4)
            leave.append(page.indent.pop)
        elif name in ("pre", "textarea", "listing", "xmp"):
            pre.append(1)
            leave.append(pre.pop)
            if children and isinstance(children[0], str) and children[0].startswith("\n"):
                children = [children[0][1:], *children[1:]]
        elif name == "q" and shown:
            page.word('"')
            leave.append(lambda p=page: p.word('"'))

        def done(p=page, gap=gap, block=block, leave=leave):
            if block:
                p.apart(gap)
            for f in leave:
                f()

        if block or leave:
            later(done)
        todo.extend(reversed(children))
    return pages[0].text()


def _number(n: Node, name: str, usual: int) -> int:
    found = re.match(r"[ \t\n\r\f]*\+?(\d{1,9})", n.attrs.get(name, ""))
    return int(found[1]) if found else usual


def _table(n: Node, pages: list[Page], later, todo: list, seen: list[str]) -> None:
    """Render each cell on a page of its own, then set the cells in columns."""
    outer = pages[-1]
    outer.apart(1)
    rows: list[list[Node]] = []
    states: list[list[str]] = []
    captions, others = [], []
    parts: list = [(c, seen[-1]) for c in reversed(n.children)]
    while parts:
        c, state = parts.pop()
        if isinstance(c, str):
            if c.strip(" \t\n\r\f"):
                others.append((c, state))
            continue
        if hidden(c):
            continue
        own = visibility(c, state)
        if own == "collapse" and c.name in ("tr", *SECTIONS):
            continue  # such rows take no place
        if c.name == "tr":
            rows.append([x for x in c.children if isinstance(x, Node) and x.name in ("td", "th") and not hidden(x)])
            states.append([visibility(x, own) for x in rows[-1]])
            others += [(x, own) for x in c.children if isinstance(x, str) and x.strip(" \t\n\r\f") or isinstance(x, Node) and x.name not in ("td", "th")]
        elif c.name in SECTIONS:
            parts += [(x, own) for x in reversed(c.children)]
        elif c.name == "caption":
            captions.append((c, own))
        elif c.name not in ("colgroup", "col"):
            others.append((c, state))

    def within(state: str, nodes: list) -> None:
        later(seen.pop)
        todo.extend(reversed(nodes))
        later(lambda: seen.append(state))

    texts: dict[tuple[int, int], list[str]] = {}

    def finish() -> None:
        grid: list[dict[int, list[str]]] = []
        widths: dict[int, int] = {}
        taken: dict[int, int] = {}  # the row from which each column is free
        for y, row in enumerate(rows):
            grid.append({})
            x = 0
            for k, cell in enumerate(row):
                while taken.get(x, 0) > y:
                    x += 1
                wide = min(max(1, _number(cell, "colspan", 1)), MOST_WIDE)
                high = min(_number(cell, "rowspan", 1), MOST_HIGH) or len(rows)
                if high > 1:
                    taken |= dict.fromkeys(range(x, x + wide), y + high)
                grid[y][x] = lines = texts[y, k]
                if wide == 1:
                    widths[x] = max(widths.get(x, 0), *(width(s) for s in lines), 0)
                x += wide
        begin, due = [], 0
        for x in range(max((x for row in grid for x in row), default=-1) + 1):
            begin.append(due)
            due += widths.get(x, 0) + 2
        for cells in grid:
            for k in range(max((len(c) for c in cells.values()), default=0)):
                line, place, late = "", 0, 0
                for x, lines in cells.items():
                    if k < len(lines) and lines[k]:
                        if line:
                            late = max(late, place + 1 - begin[x])
                        line += " " * (begin[x] + late - place) + lines[k]
                        place = begin[x] + late + width(lines[k])
                if line.strip():
                    outer._put(line)
                    outer.close()
                elif k:
                    outer.lines.append("")
        for o, state in reversed(others):
            within(state, [o])

    later(lambda: outer.apart(1))
    later(finish)
    for y in range(len(rows) - 1, -1, -1):
        for k in range(len(rows[y]) - 1, -1, -1):
            cell = rows[y][k]

            def enter():
                pages.append(Page())

            def leave(y=y, k=k):
                texts[y, k] = pages.pop().text().split("\n")

            later(leave)
            within(states[y][k], cell.children)
            later(enter)
    for c, state in reversed(captions):
        later(lambda: outer.apart(0))
        within(state, c.children)


def title(top: Node) -> str:
    found = next((c for c in top.children[0].children if isinstance(c, Node) and c.name == "title"), None)
    return _SPACES.sub(" ", "".join(x for x in found.children if isinstance(x, str))).strip() if found else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, text, n_chars, n_lines): a row a page."""
    slim = pick(pages, "page_id", "url", "html")
    kinds = dict(slim.dtypes)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            titles, texts = [], []
            for html in strings(batch.column(2)):
                tree = parse(html)
                titles.append(title(tree))
                texts.append(render(tree))
            cols = [pa.array(titles, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["page_id", "url", "title", "text", "n_chars", "n_lines"])

    return arrow_map(slim, work, f"page_id {kinds['page_id']}, url {kinds['url']}, title string, text string, n_chars long, n_lines long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
