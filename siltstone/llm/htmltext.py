"""HTML extraction by layout-aware rendering.

A tokenizer feeds a tree builder that knows implied tags (an open p ends at a block, an li at the next
li, cells and rows likewise; rows stand in an implied tbody) and void elements. The renderer drops
what is not visible and lays out the rest: blocks on lines of their own, blank lines for margins,
bullets and numbers for lists with indents, and table cells padded to common column widths.

Visibility: script, style, head, template and the like; the ``hidden`` attribute; closed details and
dialogs; hidden inputs; ``display`` and ``visibility``, inline or by the page's own style elements, for selectors
of one element (a tag, classes and ids together). Importance, specificity and order decide between them.
``display:none`` takes away all that an element holds; ``visibility`` is inherited until something sets it anew.
Rules ``margin:0`` for a tag take its blank lines away. Rules of media that are not a screen of ``WIDTH``
pixels, or whose conditions are not known here (other than widths), and selectors of several elements or with
attributes or states hide nothing. Text that stands in a table outside its cells goes before the table, as in browsers.

Defined cases: null html gives null text; empty html gives an empty text; unclosed comments, tags and
quotes run as text or to the end, never fail; elements nest to any depth, but are indented ``INDENTS`` times at
most; a very long page must fit in a task, and takes time in proportion to its length; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

INDENTS = 64
WIDTH = 1280

# Fixed lists of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title meta link base iframe object audio video canvas svg noembed noframes datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu fieldset".split())
ENDS_P = BLOCKS - frozenset("body caption dd dt html legend li optgroup option summary".split()) | {"dd", "dt", "li"}

#: Tag: open elements that it ends by implication, and those that shield them.
IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "td": (frozenset({"td", "th"}), frozenset({"table"})),
    "th": (frozenset({"td", "th"}), frozenset({"table"})),
    "tr": (frozenset({"tr", "td", "th", "caption", "colgroup"}), frozenset({"table"})),
    "tbody": (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}), frozenset({"table"})),
}
IMPLIED["thead"] = IMPLIED["tfoot"] = IMPLIED["tbody"]
ROWS = frozenset("table thead tbody tfoot tr colgroup".split())  # text right inside is none of a table's
SCOPES = frozenset({"table", "td", "th", "caption", "html"})

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>|[^<]++|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_MEDIA = re.compile(r"@media\b([^{};]*)\{", re.I)
_QUERY = re.compile(r"\s*(?:(not|only)\s+)?([a-z]+)?\s*((?:(?:and\s*)?\([^()]*\)\s*)*)", re.I)
_CONDITION = re.compile(r"\(([^()]*)\)")
_WIDTHS = re.compile(r"\s*(min|max)-width\s*:\s*(\d+(?:\.\d+)?|\.\d+)\s*(px|r?em)?\s*", re.I)
_COMPOUND = re.compile(r"([a-z][a-z0-9-]*|\*)?((?:[.#]-?[_a-z\u0080-\uffff][\w-]*)*)", re.I)
_PART = re.compile(r"[.#][\w-]+")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_FLAT = re.compile(r"0(?:px|em|rem|%)?")


class Element:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.attributes, self.children = tag, attributes, []

    def get(self, name: str) -> str | None:
        for key, a, b, c in _ATTRIBUTE.findall(self.attributes):
            if key.lower() == name:
                return html.unescape(a or b or c)
        return None


class Stack:
    """Open elements, and how many there are of each name, so that none is sought in vain."""

    def __init__(self, root: Element):
        self.open, self.count = [root], Counter()

    def push(self, element: Element) -> None:
        self.open[-1].children.append(element)
        self.open.append(element)
        self.count[element.tag] += 1

    def add(self, child: Element | str) -> None:
        self.open[-1].children.append(child)

    def cut(self, at: int) -> None:
        for e in self.open[at:]:
            self.count[e.tag] -= 1
        del self.open[at:]

    def imply(self, tag: str) -> None:
        """End what ``tag`` ends by implication, down to what shields it."""
        ended, shield = IMPLIED[tag]
        if not any(self.count[x] for x in ended):
            return
        least = len(self.open)
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in shield:
                break
            if self.open[i].tag in ended:
                least = i
        self.cut(least)

    def close(self, tag: str, quiet: bool = False) -> None:
        """End the nearest open element of that name; a lone </p> is an empty paragraph."""
        for i in range(len(self.open) - 1, 0, -1) if self.count[tag] else ():
            if self.open[i].tag == tag:
                self.cut(i)
                return
            if self.open[i].tag in SCOPES and tag not in ("table", "tbody", "thead", "tfoot", "tr", "body", "html"):
                break
        if tag == "p" and not quiet:
            self.add(Element("p", ""))

    def text(self, text: str) -> None:
        """Add a text; one that is not blank and stands between a table's cells goes before the table."""
        if self.open[-1].tag in ROWS and _SPACE.sub("", text):
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == "table":
                    self.open[i - 1].children.insert(-1, text)  # an open table is its parent's last child
                    return
        self.add(text)


def parse(source: str) -> tuple[Element, list[str]]:
    """The tree of a page, and the texts of its style elements."""
    root, styles = Element("#root", ""), []
    stack = Stack(root)
    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.match(source, at)
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            text = m[0]
            if text[0] != "<" or text == "<":
                stack.text(html.unescape(text) if "&" in text else text)
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            stack.close(tag)
            continue
        element = Element(tag, m[3] or m[6] or "")
        if tag in ENDS_P:
            stack.close("p", quiet=True)
        if tag in IMPLIED:
            stack.imply(tag)
        if tag == "tr" and stack.open[-1].tag == "table":
            stack.push(Element("tbody", ""))
        if tag in VOID:
            stack.add(element)
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            body = source[at : end.start() if end else n]
            at = end.end() if end else n
            if tag == "style" and on_screen(element.get("media") or ""):
                styles.append(body)
            element.children.append(html.unescape(body) if tag in ("textarea", "title") else body)
            stack.add(element)
        else:
            stack.push(element)
    return root, styles


def on_screen(media: str) -> bool:
    """Whether a list of media queries surely holds for a screen of ``WIDTH`` pixels."""
    return any(_holds(query) for query in media.split(","))


def _holds(query: str) -> bool:
    m = _QUERY.fullmatch(query)
    if not m:
        return False
    right = (m[2] or "all").lower() in ("all", "screen")
    if (m[1] or "").lower() == "not":
        return not right
    for condition in _CONDITION.findall(m[3]):
        w = _WIDTHS.fullmatch(condition)
        if not w:
            return False
        width = float(w[2]) * (16 if "em" in (w[3] or "").lower() else 1)
        right = right and (WIDTH >= width if w[1].lower() == "min" else WIDTH <= width)
    return right


def for_screen(style: str) -> str:
    """A style sheet without the @media blocks that are not for the screen."""
    out, at = [], 0
    while m := _MEDIA.search(style, at):
        out.append(style[at : m.start()])
        at = m.end()
        if not on_screen(m[1]):
            depth = 1
            for brace in re.finditer(r"[{}]", style[at:]):
                depth += 1 if brace[0] == "{" else -1
                if not depth:
                    at += brace.end()
                    break
            else:
                at = len(style)
        else:
            out.append("}")  # its rules follow on their own
    out.append(style[at:])
    return "".join(out)


def declarations(body: str) -> list[tuple[str, str, bool]]:
    """(property, value, important) in order."""
    out = []
    for part in body.split(";"):
        name, colon, value = part.partition(":")
        if colon:
            value, bang, _ = value.partition("!")
            out.append((name.strip().lower(), value.strip().lower(), bool(bang)))
    return out


class Rules:
    """What the page's own style rules say of display and visibility, and of which tags' margins."""

    def __init__(self, styles: list[str]):
        #: By tag, .class, #id or *: (precedence, tag, classes and ids, property, value).
        self.by: dict[str, list[tuple[tuple, str, frozenset[str], str, str]]] = {}
        self.flat: set[str] = set()
        order = 0
        for style in styles:
            for selectors, body in _RULE.findall(for_screen(_COMMENT.sub("", style))):
                said = declarations(body)
                for selector in selectors.split(","):
                    order += 1
                    m = _COMPOUND.fullmatch(selector.strip())
                    if m and m[0]:
                        self.add(m[1] or "*", _PART.findall(m[2]), said, order)

    def add(self, tag: str, parts: list[str], said: list[tuple[str, str, bool]], order: int) -> None:
        tag = tag.lower()
        weight = (sum(p[0] == "#" for p in parts), sum(p[0] == "." for p in parts), tag != "*")
        for name, value, important in said:
            if name in ("display", "visibility"):
                self.by.setdefault(parts[0] if parts else tag, []).append(((important, 1, weight, order), tag, frozenset(parts), name, value))
            elif name == "margin" and not parts and _FLAT.fullmatch(value):
                self.flat.add(tag)

    def style(self, e: Element) -> dict[str, str]:
        """The values of display and visibility that hold for an element, of those that are set."""
        attributes = e.attributes.lower()
        own = set()
        if self.by and "class" in attributes:
            own.update("." + c for c in (e.get("class") or "").split())
        if self.by and "id" in attributes and e.get("id"):
            own.add("#" + e.get("id"))
        found: dict[str, tuple[tuple, str]] = {}
        if "hidden" in attributes and (e.get("hidden") is not None or e.tag == "input" and e.get("type") == "hidden"):
            found["display"] = (False, 0), "none"
        if e.tag == "dialog" and ("open" not in attributes or e.get("open") is None):
            found["display"] = (False, 0), "none"
        for key in (e.tag, "*", *own) if self.by else ():
            for precedence, tag, parts, name, value in self.by.get(key, ()):
                if tag in ("*", e.tag) and parts <= own and (name not in found or precedence > found[name][0]):
                    found[name] = precedence, value
        if "style" in attributes:
            for name, value, important in declarations(e.get("style") or ""):
                if name in ("display", "visibility") and (name not in found or (important, 2) >= found[name][0][:2]):
                    found[name] = (important, 2), value
        return {name: value for name, (_, value) in found.items()}


class Box:
    """Lines under construction."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = 0  # blank lines due before the next line
        self.indent: list[str] = []
        self.lead: str | None = None  # bullet or number of the next line
        self.pre = 0

    def text(self, text: str) -> None:
        if self.pre:
            first, *rest = text.split("\n")
            self.inline.append(first)
            for line in rest:
                self.end(force=True)
                self.inline.append(line)
        else:
            self.inline.append(text)

    def end(self, force: bool = False) -> None:
        """End the line at hand."""
        line = "".join(self.inline)
        self.inline.clear()
        line = line.rstrip() if self.pre else _SPACE.sub(" ", line).strip(" ")
        if line or force:
            self.put(line)

    def put(self, line: str) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        lead = "".join(self.indent[:INDENTS])
        if self.lead is not None:
            lead = "".join(self.indent[:-1][:INDENTS]) + self.lead
            self.lead = None
        self.lines.append((lead + line).rstrip())

    def space(self, lines: int) -> None:
        self.gap = max(self.gap, lines)


def render(root: Element, rules: Rules) -> str:
    box = Box()
    boxes = [box]
    tables: list[list[list[Cell]]] = []
    counters: list[int | None] = []
    todo: list = [(root, False, True)]
    while todo:
        node, leaving, seen = todo.pop()
        if isinstance(node, str):
            if seen:
                box.text(node)
            continue
        tag = node.tag
        if leaving:
            if tag in ("td", "th") and tables and len(boxes) > 1:
                box.end()
                lines = box.lines or [""]
                boxes.pop()
                box = boxes[-1]
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append((lines, span_of(node, "colspan", 1000) or 1, span_of(node, "rowspan", 65534)))
            elif tag == "table":
                box.end()
                for line in aligned(tables.pop()):
                    box.put(line)
                box.space(1)
            elif tag in BLOCKS:
                box.end()
                if tag == "pre":
                    box.pre -= 1
                if tag in ("ul", "ol", "menu", "dir"):
                    counters.pop()
                if tag == "li":
                    box.lead = None
                    box.indent.pop()
                elif tag in ("blockquote", "dd"):
                    box.indent.pop()
                if tag in SPACED and tag not in rules.flat and not (tag in ("ul", "ol", "menu") and counters):
                    box.space(1)
            continue
        if tag in UNSEEN:
            continue
        if rules.by or node.attributes or tag == "dialog":
            style = rules.style(node)
            if style.get("display") == "none":
                continue
            if style.get("visibility") in ("visible", "hidden", "collapse"):
                seen = style["visibility"] == "visible"
        if tag == "br":
            if seen:
                box.end(force=True)
            continue
        if tag in VOID:
            if tag == "hr":
                box.end()
                box.space(1)
            continue
        todo.append((node, True, seen))
        children = node.children
        if tag == "table":
            box.end()
            box.space(0 if "table" in rules.flat else 1)
            tables.append([])
            captions = [c for c in children if not isinstance(c, str) and c.tag == "caption"]
            children = [c for c in children if not isinstance(c, str) and c.tag != "caption"]
            todo += [(c, False, seen) for c in reversed(captions + children)]
            continue
        if tag == "tr" and tables:
            tables[-1].append([])
        elif tag in ("td", "th") and tables:
            box = Box()
            boxes.append(box)
        elif tag == "details" and node.get("open") is None:
            children = [c for c in children if not isinstance(c, str) and c.tag == "summary"][:1]
        if tag in BLOCKS:
            box.end()
            if tag in SPACED and tag not in rules.flat and not (tag in ("ul", "ol", "menu") and counters):
                box.space(1)
            if tag == "pre":
                box.pre += 1
                if children and isinstance(children[0], str):
                    children = [children[0].removeprefix("\n"), *children[1:]]
            if tag in ("ul", "ol", "menu", "dir"):
                begin = node.get("start") if node.attributes else None
                counters.append(int(begin) if tag == "ol" and begin and begin.isdigit() else 1 if tag == "ol" else None)
            if tag == "li":
                mark = "* "
                if counters and counters[-1] is not None:
                    mark = f"{counters[-1]}. "
                    counters[-1] += 1
                box.lead = mark if seen else box.lead
                box.indent.append(" " * len(mark))
            elif tag in ("blockquote", "dd"):
                box.indent.append("    ")
        if tag in ROWS:
            children = [c for c in children if not isinstance(c, str) or _SPACE.sub("", c)]
        todo += [(c, False, seen) for c in reversed(children)]
    box.end()
    return "\n".join(boxes[0].lines).strip("\n")


#: Lines, columns and rows of a cell; 0 rows: all that follow.
Cell = tuple[list[str], int, int]


def span_of(cell: Element, name: str, most: int) -> int:
    """A span attribute, 1 unless it is a number, and at most HTML's own limit."""
    span = cell.get(name) if cell.attributes else None
    return min(most, int(span)) if span and span.isascii() and span.isdigit() else 1


def placed(rows: list[list[Cell]]) -> list[list[tuple[int, int, list[str]]]]:
    """The cells of each row as (first column, columns, lines), beside those that reach down from above."""
    out, held = [], {}  # column: rows that a cell above still takes there
    for i, row in enumerate(rows):
        at, cells, down = 0, [], {}
        for lines, span, deep in row:
            while at in held:
                at += 1
            cells.append((at, span, lines))
            deep = len(rows) - i if deep == 0 else min(deep, len(rows) - i)
            if deep > 1:
                down.update(dict.fromkeys(range(at, at + span), deep))
            at += span
        out.append(cells)
        held = {c: n - 1 for c, n in (held | down).items() if n > 1}
    return out


def aligned(rows: list[list[Cell]]) -> list[str]:
    """Lines of a table whose cells are padded to common column widths."""
    grid = placed(rows)
    widths = [0] * max((at + span for row in grid for at, span, _ in row), default=0)
    for row in grid:
        for at, span, lines in row:
            if span == 1:
                widths[at] = max(widths[at], max(map(len, lines)))
    for row in grid:
        for at, span, lines in row:
            short = max(map(len, lines)) - sum(widths[at : at + span]) - 2 * (span - 1)
            if short > 0:
                widths[at + span - 1] += short
    starts = [0, *accumulate(w + 2 for w in widths)]
    out = []
    for row in grid:
        for i in range(max((len(lines) for _, _, lines in row), default=0)):
            line = ""
            for at, _, lines in row:
                if i < len(lines) and lines[i]:
                    line = line.ljust(starts[at]) + lines[i]
            out.append(line.rstrip())
    return out


def visible_text(source: str) -> str:
    root, styles = parse(source)
    return render(root, Rules(styles))


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                text = pa.array([None if x is None else visible_text(x) for x in part.column("html").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), text], names=["page_id", "url", "text"])

    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string")
