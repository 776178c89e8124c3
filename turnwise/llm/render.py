"""Layout-aware text of HTML pages: a tree with implied tags, visibility rules, and blocks as lines.

Trees of any depth are walked: what would call itself hands its calls to run(), which keeps them on a list.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of all columns but the last are wrapped at so many characters; a longer word widens its column, up to LONGEST_WORD, and is cut there.
WRAP, LONGEST_WORD = 80, 1000
MAX_COLSPAN = 1000
#: Deeper lists and quotes keep their marks and are indented no further.
MAX_INDENT = 64

# Fixed values of the HTML standard: element names by how they are parsed and shown.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes textarea title".split())
HEAD = set("base link meta title script style template noscript".split())
NOT_SHOWN = set("head title script style template noscript iframe audio video canvas datalist noembed noframes annotation annotation-xml rp".split())
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dt dd".split()
)
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl table blockquote pre figure hr fieldset".split())
BLOCKS = CLOSES_P | set("html body li dt dd tr td th caption thead tbody tfoot option optgroup legend".split())
# A start tag closes open elements of its set, out to the nearest element of its scope.
_LISTS, _TABLES = {"ul", "ol", "menu", "dir"}, {"table"}
_CLOSERS = {
    "li": ({"li"}, _LISTS | _TABLES | {"td", "th"}),
    "dt": ({"dt", "dd"}, {"dl"} | _TABLES),
    "dd": ({"dt", "dd"}, {"dl"} | _TABLES),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "caption": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, _TABLES),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, _TABLES),
    "td": ({"td", "th", "caption", "colgroup"}, _TABLES | {"tr"}),
    "th": ({"td", "th", "caption", "colgroup"}, _TABLES | {"tr"}),
    **{t: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, _TABLES) for t in ("thead", "tbody", "tfoot")},
}
_P_SCOPE = {"table", "td", "th", "caption", "button", "object", "template"}
_PARTS_OF_TABLE = {"table", "thead", "tbody", "tfoot", "tr"}
_IN_TABLE = _PARTS_OF_TABLE - {"table"} | {"td", "th", "caption"}
_STAY_IN_TABLE = _IN_TABLE | HEAD | {"colgroup", "col"}
#: Of svg, the elements whose text is drawn, and those that are only defined.
_SVG_TEXT, _SVG_UNSEEN = {"text", "foreignobject"}, set("defs symbol clippath mask pattern marker desc metadata".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)"
    r"""|<([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_DISPLAY = re.compile(r"(?i)(?:^|;)\s*display\s*:\s*([a-z-]+)")
_VISIBILITY = re.compile(r"(?i)(?:^|;)\s*visibility\s*:\s*([a-z]+)")
_AT_RULE = re.compile(r"/\*.*?(?:\*/|\Z)|@[^{};]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*\})", re.S)
_CSS_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SELECTOR = re.compile(r"([A-Za-z][\w-]*|\*)?((?:[.#][\w-]+)*)")
_END_OF = {t: re.compile(rf"(?i)</{t}(?=[\s/>])[^>]*(?:>|\Z)") for t in RAW}
_BREAK = "\0"


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def css_rules(css: str) -> list[tuple[str, set[str], set[str], bool]]:
    """(tag, ids, classes, whether it leaves no box) of the simple selectors that hide what they select.

    Selectors of several elements, of attributes or states, and rules within @media and the like are left out.
    """
    found = []
    for selectors, body in _CSS_RULE.findall(_AT_RULE.sub(" ", css)):
        display, visibility = _DISPLAY.search(body), _VISIBILITY.search(body)
        none = bool(display) and display[1].lower() == "none"
        if not none and not (visibility and visibility[1].lower() in ("hidden", "collapse")):
            continue
        for one in selectors.split(","):
            m = _SELECTOR.fullmatch(one.strip())
            if m and one.strip():
                marks = re.findall(r"[.#][\w-]+", m[2])
                found.append(((m[1] or "*").lower(), {x[1:] for x in marks if x[0] == "#"}, {x[1:] for x in marks if x[0] == "."}, none))
    return found


def parse(page: str) -> tuple[Element, list]:
    """The tree of a page and the rules of its style sheets; tags that authors may leave out are put in, stray end tags are ignored."""
    root = Element("html")
    rules: list = []
    stack = [root]
    opened: Counter[str] = Counter()  # tags on the stack above the root
    in_head = True

    def push(node: Element) -> None:
        stack.append(node)
        opened[node.tag] += 1

    def cut(i: int) -> None:
        opened.subtract(e.tag for e in stack[i:])
        del stack[i:]

    def close(tags: set[str], scope: set[str]) -> None:
        while any(opened[t] > 0 for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in tags:
                    cut(i)
                    break
                if stack[i].tag in scope:
                    return
            else:
                return

    def put(node: Element | str) -> None:
        top = stack[-1]
        stray = node.strip() if isinstance(node, str) else node.tag not in _STAY_IN_TABLE
        if top.tag in _PARTS_OF_TABLE and stray and opened["table"] > 0:  # what a table can't hold goes before it
            i = len(stack) - 1
            while i and (stack[i].tag != "table" or stack[i - 1].tag in _PARTS_OF_TABLE):
                i -= 1
            if i:
                stack[i - 1].children.insert(len(stack[i - 1].children) - 1, node)
                return
        top.children.append(node)

    def leave_head() -> None:
        if len(stack) > 1 and stack[1].tag == "head":
            cut(1)

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            if text.strip():
                if in_head and stack[-1].tag == "head":
                    leave_head()
                in_head = in_head and not text.strip()
            put(html.unescape(text).replace(_BREAK, "�"))
        if m is None:
            return root, rules
        at = m.end()
        if end := m[1]:
            tag = end.lower()
            if tag == "p" and not opened["p"]:
                put(Element("p"))
            elif tag == "br":
                put(Element("br"))
            elif opened[tag] > 0:
                inner = _PARTS_OF_TABLE | {"td", "th", "caption"}
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        cut(i)
                        break
                    if stack[i].tag in {"table", "td", "th"} and tag not in inner:
                        break
            continue
        tag = (m[2] or m[4] or "").lower()
        if not tag:
            continue
        attrs = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(m[3] or m[5] or "")}
        if tag in ("html", "body"):
            leave_head()
            root.attrs |= {k: v for k, v in attrs.items() if k not in root.attrs}
            in_head = in_head and tag == "html"
            continue
        if tag == "head":
            if in_head and len(stack) == 1:
                put(node := Element("head"))
                push(node)
            continue
        if tag not in HEAD:
            leave_head()
            in_head = False
        if tag in CLOSES_P:
            close({"p"}, _P_SCOPE)
        if tag in _CLOSERS:
            close(*_CLOSERS[tag])
            if tag in _IN_TABLE and opened["table"] > 0:  # back out of what was moved before the table
                i = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in _PARTS_OF_TABLE), 0)
                if i:
                    cut(i + 1)
            if tag in ("td", "th") and stack[-1].tag in _PARTS_OF_TABLE - {"tr"}:
                put(row := Element("tr"))
                push(row)
        node = Element(tag, attrs)
        put(node)
        if (opened["svg"] > 0 or opened["math"] > 0 or tag in ("svg", "math")) and (m[3] or m[5] or "").endswith("/"):
            continue
        if tag in RAW:
            end = _END_OF[tag].search(page, at)
            body = page[at : end.start() if end else len(page)]
            node.children.append(html.unescape(body) if tag in ("textarea", "title") else body)
            at = end.end() if end else len(page)
            if tag == "style":
                rules += css_rules(body)
        elif tag not in VOID and tag != "colgroup":
            push(node)


def _is(e: Element, rule: tuple) -> bool:
    tag, ids, classes, _ = rule
    return (tag in ("*", e.tag)) and (not ids or ids <= {e.attrs.get("id")}) and (not classes or classes <= set(e.attrs.get("class", "").split()))


def shown(e: Element, rules: list = ()) -> bool:
    """Whether an element has a box at all."""
    if e.tag in NOT_SHOWN or (e.tag == "dialog" and "open" not in e.attrs):
        return False
    if m := _DISPLAY.search(e.attrs.get("style", "")):
        return m[1].lower() != "none"
    return "hidden" not in e.attrs and not any(r[3] and _is(e, r) for r in rules)


def visible(e: Element, inherited: bool, rules: list = ()) -> bool:
    """Whether the text of an element is seen: its own setting, or that of what it is in."""
    if m := _VISIBILITY.search(e.attrs.get("style", "")):
        if m[1].lower() in ("visible", "hidden", "collapse"):
            return m[1].lower() == "visible"
    return False if any(not r[3] and _is(e, r) for r in rules) else inherited


def run(call):
    """The value of a generator that yields generators of the values it needs, without nesting their calls."""
    stack, value = [call], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def _trimmed(lines: list[str]) -> list[str]:
    """Without blank lines at the ends, and with at most one between others."""
    out: list[str] = []
    for x in lines:
        if x or (out and out[-1]):
            out.append(x)
    while out and not out[-1]:
        out.pop()
    return out


def wrapped(line: str, width: int) -> list[str]:
    """A line in pieces of at most `width` characters, cut at spaces where there are any."""
    out = []
    while len(line) > width:
        at = line.rfind(" ", 1, width + 1)
        at = at if at > 0 else width
        out.append(line[:at].rstrip())
        line = line[at:].lstrip()
    return [*out, line]


class Page:
    """The visible text of a tree by the rules of its page. Methods that end in calls are for run()."""

    def __init__(self, rules: list):
        self.rules = rules

    def shown(self, e: Element) -> bool:
        return shown(e, self.rules)

    def seen(self, e: Element, inherited: bool) -> bool:
        return visible(e, inherited, self.rules)

    def raw_calls(self, e: Element, seen: bool):
        """Text as it stands, for preformatted blocks."""
        out = []
        for c in e.children:
            if isinstance(c, str):
                out.append(c if seen else "")
            elif c.tag == "br":
                out.append("\n")
            elif self.shown(c):
                out.append((yield self.raw_calls(c, self.seen(c, seen))))
        return "".join(out)

    def lines_calls(self, e: Element, seen: bool, depth: int):
        """The visible text below an element, a block to a line or more, blank lines around spaced blocks."""
        out: list[str] = []
        pieces: list[str] = []

        def flush() -> None:
            if pieces:
                parts = _SPACE.sub(" ", "".join(pieces)).split(_BREAK)
                if parts[-1].strip(" ") == "":
                    parts.pop()
                out.extend(p.strip(" ").replace("\xa0", " ") for p in parts)
                pieces.clear()

        def drawn_calls(e: Element, seen: bool):
            for c in e.children:
                if isinstance(c, Element) and self.shown(c) and c.tag not in _SVG_UNSEEN:
                    if c.tag in _SVG_TEXT:
                        pieces.append(" ")
                        yield walk_calls(c, self.seen(c, seen))
                        pieces.append(" ")
                    else:
                        yield drawn_calls(c, self.seen(c, seen))

        def walk_calls(e: Element, seen: bool):
            number = int(e.attrs["start"]) if re.fullmatch(r"-?\d{1,9}", e.attrs.get("start", "")) else 1
            for c in e.children:
                if isinstance(c, str):
                    if seen:
                        pieces.append(c)
                    continue
                tag = c.tag
                if not self.shown(c):
                    continue
                see = self.seen(c, seen)
                if tag == "br":
                    pieces.append(_BREAK)
                elif tag == "input":
                    if see and c.attrs.get("type", "").lower() in ("submit", "button", "reset"):
                        pieces.append(c.attrs.get("value", ""))
                elif tag == "svg":
                    yield drawn_calls(c, see)
                elif tag not in BLOCKS:
                    yield walk_calls(c, see)
                else:
                    flush()
                    out.extend([""] * (tag in SPACED))
                    if tag == "table":
                        out.extend((yield self.table_calls(c, see)))
                    elif tag == "pre":
                        text = yield self.raw_calls(c, see)
                        out.extend(x.rstrip() for x in text.removeprefix("\n").split("\n"))
                    elif tag == "hr":
                        out.extend(["---"] * see)
                    elif tag == "li":
                        if re.fullmatch(r"-?\d{1,9}", c.attrs.get("value", "")):
                            number = int(c.attrs["value"])
                        mark = f"{number}. " if e.tag == "ol" else "- "
                        number += 1
                        inner = _trimmed((yield self.lines_calls(c, see, depth + 1)))
                        if see or inner:
                            inner = inner or [""]
                            indent = " " * len(mark) if depth < MAX_INDENT else ""
                            out.append((mark + inner[0]).rstrip())
                            out.extend(indent + x if x else x for x in inner[1:])
                    elif tag in ("blockquote", "dd"):
                        mark = ("> " if tag == "blockquote" else "  ") if depth < MAX_INDENT else ""
                        out.extend((mark + x).rstrip() for x in _trimmed((yield self.lines_calls(c, see, depth + 1))))
                    elif tag == "details" and "open" not in c.attrs:
                        for s in c.children:
                            if isinstance(s, Element) and s.tag == "summary" and self.shown(s):
                                out.extend((yield self.lines_calls(s, self.seen(s, see), depth)))
                    elif tag in ("ul", "ol", "menu", "dir") and e.tag == "li":
                        out.pop()  # a list within an item follows its text closely
                        yield walk_calls(c, see)
                        flush()
                        continue
                    else:
                        yield walk_calls(c, see)
                        flush()
                    out.extend([""] * (tag in SPACED))

        yield walk_calls(e, seen)
        flush()
        return out

    def table_calls(self, e: Element, seen: bool):
        """Rows as lines with cells in columns; a cell of several lines takes as many."""
        rows: dict[str, list[tuple[Element, bool]]] = {"thead": [], "": [], "tfoot": []}
        above: list[str] = []

        def gather_calls(part: Element, into: str, seen: bool):
            for c in part.children:
                if isinstance(c, Element) and self.shown(c):
                    see = self.seen(c, seen)
                    if c.tag == "tr":
                        rows[into].append((c, see))
                    elif c.tag in ("thead", "tbody", "tfoot"):
                        yield gather_calls(c, c.tag if c.tag in rows else "", see)
                    elif c.tag == "caption":
                        above.extend(_trimmed((yield self.lines_calls(c, see, 0))))

        yield gather_calls(e, "", seen)
        grid: list[list[list[str]]] = []
        for part in rows.values():
            spans: dict[int, int] = {}  # rows that a cell above still takes, by column
            for k, (row, see) in enumerate(part):
                cells: list[list[str]] = []

                def skip() -> None:
                    while spans.get(len(cells), 0) > 0:
                        spans[len(cells)] -= 1
                        cells.append([])

                for c in row.children:
                    if isinstance(c, Element) and c.tag in ("td", "th") and self.shown(c):
                        skip()
                        wide, tall = (int(v) if re.fullmatch(r"\d{1,5}", v := c.attrs.get(name, "")) else 1 for name in ("colspan", "rowspan"))
                        tall = tall or len(part) - k  # 0 is to the end of the part
                        inner = _trimmed((yield self.lines_calls(c, self.seen(c, see), 0)))
                        for i in range(min(max(1, wide), MAX_COLSPAN)):
                            if tall > 1:
                                spans[len(cells)] = tall - 1
                            cells.append(inner if i == 0 else [])
                skip()
                while cells and not cells[-1]:
                    cells.pop()
                grid.append(cells)
        width: dict[int, int] = {}
        for cells in grid:
            for i, c in enumerate(cells[:-1]):
                for x in c:
                    need = len(x) if len(x) <= WRAP else max(WRAP, min(LONGEST_WORD, max(map(len, x.split(" ")))))
                    width[i] = max(width.get(i, 0), need)
        for cells in grid:
            last = len(cells) - 1
            cells = [c if i == last else [y for x in c for y in wrapped(x, max(1, width.get(i, 0)))] for i, c in enumerate(cells)]
            for k in range(max(map(len, cells), default=0)):
                above.append(" | ".join((c[k] if k < len(c) else "").ljust(width.get(i, 0) if i < last else 0) for i, c in enumerate(cells)).rstrip())
        return above


def lines(e: Element, rules: list = ()) -> list[str]:
    """The visible text of a tree as lines."""
    return run(Page(rules).lines_calls(e, visible(e, True, rules), 0)) if shown(e, rules) else []


def render(page: str | None) -> tuple[str, str]:
    """(title, visible text) of a page."""
    tree, rules = parse(page or "")
    title = ""
    todo = [tree]
    while todo and not title:
        e = todo.pop()
        if e.tag == "title":
            title = _SPACE.sub(" ", "".join(c for c in e.children if isinstance(c, str))).strip()
        todo += [c for c in reversed(e.children) if isinstance(c, Element) and c.tag != "svg"]
    return title, "\n".join(_trimmed(lines(tree, rules)))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, title, text) of every row.

    A null or empty page has an empty title and text; text without any tag is itself. Broken markup
    is read as browsers do: unclosed elements end with their parents, stray end tags are ignored, a
    cut-off tag ends the page. What is hidden by the hidden attribute, inline styles or simple
    selectors (element, class, id) of the page's own style sheets is left out, closed dialogs and
    details too; other selectors and linked sheets don't count. Repeated rows repeat; other columns
    are ignored; an empty table gives no rows.
    """

    def render_all(batches):
        for b in batches:
            found = [render(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array([f[i] for f in found], pa.string()) for i in range(2))], names=["page_id", "title", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(render_all, "page_id long, title string, text string")
