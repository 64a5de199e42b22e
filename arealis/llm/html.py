"""Visible text of web pages, laid out as a browser would: blocks, lists, aligned tables.

A tokenizer feeds a tree builder that supplies implied end tags; visibility rules (hidden
elements, ``hidden``, ``display:none`` in attributes and simple style rules) prune the
tree; a renderer walks what is left. Nothing is judged by its content: all visible text
is kept, navigation and advertisements included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN_TAGS = frozenset("head script style template noscript title meta link base datalist iframe noembed noframes param rp audio video canvas".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr".split())
BLOCK = SPACED | frozenset("html body address article aside center details dialog dd div dt figcaption footer form header hgroup legend li main menu nav section summary search optgroup option caption tr td th thead tbody tfoot".split())
CLOSES_P = SPACED | frozenset("address article aside center details dialog dd dir div dt figcaption footer form header hgroup li main menu nav section summary".split())
#: In drawings, characters show inside these alone, and never below those that only define or describe.
DRAWN = frozenset("text foreignobject".split())
UNDRAWN = frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter".split())
UNSHOWN_MATH = frozenset("annotation annotation-xml mphantom".split())
#: Inputs that show no text of their own.
WORDLESS = frozenset("hidden password checkbox radio range color file image".split())
#: Start tag -> (what it ends, where the search for that stops).
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
SCOPE = frozenset("table td th caption button html object".split())
ATTRIBUTES = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
#: What is given up is never tried again, and an unquoted ``<`` ends the try: a page of
#: open tags without end takes no more steps than characters.
TAG = re.compile(r"""<(?:(!--)|([!?])|(/?)([A-Za-z][^\s/<>]*+)((?:[^"'<>]++|"[^"]*+"|'[^']*+')*+)>)""")
SPACE = re.compile(r"[ \t\n\r\f]+")
NO_DISPLAY = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
SIMPLE = re.compile(r"[a-z][a-z0-9]*|[.#][\w-]+|[a-z][a-z0-9]*[.#][\w-]+", re.I)

#: Lines of a cell are wrapped at blanks to this width, so that columns stay aligned. Words
#: that are longer widen their column, as long as a table's padding stays below PADDING
#: times its text.
WRAP, PADDING = 80, 8


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def parse(html: str) -> tuple[Node, list[str]]:
    """The tree under a root node, and the texts of style elements. Never fails: what is
    no tag is text, what is never closed ends with the page, stray end tags are ignored."""
    root = Node("#root", {})
    stack, styles, at, lower = [root], [], 0, None
    places: dict[str, list[int]] = {}  # where in the stack each tag is open
    last = html.rfind(">")

    def last_of(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(names, stops) -> None:
        """Close the elements of these names that are open above the last stop."""
        stop = last_of(stops)
        lowest = min((p for n in names for p in ((places.get(n) or ())[-1:] if len(names) == 1 else places.get(n) or ()) if p > stop), default=0)
        while lowest and len(stack) > lowest:
            places[stack.pop().tag].pop()

    while True:
        m = TAG.search(html, at) if at <= last else None
        if not m:
            stack[-1].children.append(html[at:])
            return root, styles
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        if m[1]:
            end = html.find("-->", m.end())
            at = len(html) if end < 0 else end + 3
            continue
        if m[2]:
            end = html.find(">", m.end())
            at = len(html) if end < 0 else end + 1
            continue
        at, tag = m.end(), m[4].lower()
        if m[3]:
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif places.get(tag):
                stops = () if tag in ("table", "html", "body") else ("table",) if tag in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption") else ("td", "th", "caption")
                close({tag}, stops)
            continue
        if tag in CLOSES_P:
            close({"p"}, SCOPE)
        if tag in ENDS:
            close(*ENDS[tag])
        attrs = {}
        if m[5] and m[5] != "/":
            for k, a, b, c in ATTRIBUTES.findall(m[5]):
                attrs.setdefault(k.lower(), unescape(a or b or c))
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in RAW:
            lower = lower if lower is not None else html.lower()
            end = lower.find(f"</{tag}", at) if len(lower) == len(html) else -1
            if end < 0:
                found = re.compile(f"</{tag}", re.I).search(html, at)
                end = found.start() if found else len(html)
            if tag == "style":
                styles.append(html[at:end])
            elif tag == "textarea":
                node.children.append(html[at:end])
            close_at = html.find(">", end)
            at = len(html) if close_at < 0 else close_at + 1
        elif tag not in VOID and not (m[5] and m[5].endswith("/") and (tag in ("svg", "math") or places.get("svg") or places.get("math"))):
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)


def hiding_rules(styles: list[str]) -> set[str]:
    """Simple selectors (tag, .class, #id, tag.class, tag#id) that style rules hide."""
    out = set()
    for style in styles:
        plain = []
        while style:
            before, _, style = style.partition("/*")
            plain.append(before)
            style = style.partition("*/")[2]
        for rule in "".join(plain).split("}")[:-1]:
            head, brace, body = rule.rpartition("{")
            selectors = head.rpartition("{")[2]
            if brace and NO_DISPLAY.search(body):
                out.update(s.strip() for s in selectors.split(",") if SIMPLE.fullmatch(s.strip()))
    return out


def is_hidden(node: Node, rules: set[str]) -> bool:
    a, tag = node.attrs, node.tag
    if tag in HIDDEN_TAGS or "hidden" in a or (tag == "input" and a.get("type", "").lower() == "hidden"):
        return True
    if (tag == "dialog" and "open" not in a) or NO_DISPLAY.search(a.get("style", "")):
        return True
    if rules:
        names = [f".{c}" for c in a.get("class", "").split()] + ([f"#{a['id']}"] if "id" in a else [])
        return tag in rules or any(n in rules or tag + n in rules for n in names)
    return False


def drawn(svg: Node, rules: set[str]) -> list[Node]:
    """The elements of a drawing whose characters show, in order."""
    out, todo = [], list(reversed(svg.children))
    while todo:
        node = todo.pop()
        if isinstance(node, str) or node.tag in UNDRAWN or is_hidden(node, rules):
            continue
        if node.tag in DRAWN:
            out.append(node)
        else:
            todo += reversed(node.children)
    return out


def field_text(node: Node) -> str:
    """What an input or textarea shows: its value, or its placeholder."""
    a = node.attrs
    if node.tag == "textarea":
        return unescape("".join(node.children)).replace("\r\n", "\n").strip("\n") or a.get("placeholder", "")
    kind = a.get("type", "").strip().lower()
    if kind in WORDLESS:
        return ""
    return a.get("value", "") or ("" if kind in ("submit", "reset", "button") else a.get("placeholder", ""))


class Page:
    """Lines under construction: inline text runs on until a block ends it."""

    __slots__ = ("gap", "line", "lines", "rows", "table")

    def __init__(self, table: bool = False):
        self.table = table
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.rows: list[list[list[str]]] = []

    def put(self, text: str, pre: bool) -> None:
        if pre:
            first, *rest = text.split("\n")
            self._add(first)
            for x in rest:
                self.end(0, force=True)
                self._add(x)
            return
        text = SPACE.sub(" ", text)
        if text and (text != " " or (self.line and not self.line[-1].endswith(" "))):
            self._add(text[1:] if text[0] == " " and (not self.line or self.line[-1].endswith(" ")) else text)

    def _add(self, text: str) -> None:
        if text:
            if not self.line and self.lines and self.gap:
                self.lines += [""] * (self.gap if self.lines[-1] else 0)
            self.gap = 0
            self.line.append(text)

    def end(self, gap: int, force: bool = False) -> None:
        if self.line or force:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.gap = max(self.gap, gap)

    def block(self, lines: list[str], gap: int) -> None:
        self.end(gap)
        if lines:
            if self.lines and self.gap and self.lines[-1]:
                self.lines.append("")
            self.lines += lines
            self.gap = gap

    def done(self) -> list[str]:
        self.end(0)
        lines = self.lines
        a, b = 0, len(lines)
        while a < b and not lines[a].strip():
            a += 1
        while b > a and not lines[b - 1].strip():
            b -= 1
        return lines[a:b]


def wrapped(line: str) -> list[str]:
    """A line of a cell, broken at blanks where it is wider than WRAP."""
    if len(line) <= WRAP:
        return [line]
    out, words, size = [], [], 0
    for word in line.split(" "):
        if words and size + len(word) > WRAP:
            out.append(" ".join(words))
            words, size = [], 0
        words.append(word)
        size += len(word) + 1
    return [*out, " ".join(words)]


def lay_out(rows: list[list[list[str]]]) -> list[str]:
    """Table rows (cells of lines) as aligned text, cells set apart by `` | ``."""
    rows = [[[x for line in cell for x in wrapped(line)] for cell in row] for row in rows]
    n_lines = sum(max((len(c) for c in row), default=0) * len(row) for row in rows)
    most = max(WRAP, PADDING * sum(len(x) for row in rows for cell in row for x in cell) // max(1, n_lines))
    widths: list[int] = []
    for row in rows:
        for i, cell in enumerate(row):
            width = min(most, max(map(len, cell), default=0))
            if i == len(widths):
                widths.append(width)
            elif width > widths[i]:
                widths[i] = width
    out = []
    for row in rows:
        for k in range(max((len(c) for c in row), default=0)):
            parts = [cell[k] if k < len(cell) else "" for cell in row]
            out.append(" | ".join([*(p.ljust(w) for p, w in zip(parts[:-1], widths, strict=False)), parts[-1]]).rstrip())
    return out


def render(html: str | None) -> str:
    """All visible text of a page; null and empty pages give an empty text."""
    if not html:
        return ""
    root, styles = parse(html)
    rules = hiding_rules(styles)
    pages, pre, counters = [Page()], 0, []
    todo: list[tuple[Node | str, bool]] = [(root, True)]
    while todo:
        node, enter = todo.pop()
        if isinstance(node, str):
            pages[-1].put(unescape(node) if "&" in node else node, pre > 0)
            continue
        tag, page = node.tag, pages[-1]
        if enter:
            if is_hidden(node, rules):
                continue
            if tag == "br":
                page.end(0, force=True)
                continue
            if tag in ("input", "textarea"):
                if shown := field_text(node):
                    page.put(" ", False)
                    page.put(shown, tag == "textarea")
                    page.put(" ", False)
                continue
            if tag in VOID or tag in UNSHOWN_MATH:
                continue
            if tag in ("td", "th", "tr") and not page.table:  # outside a table the tag means nothing, its text shows
                todo += [(k, True) for k in reversed(node.children)]
                continue
            todo.append((node, False))
            kids = node.children
            if tag == "svg":
                kids = [x for k in drawn(node, rules) for x in (Node("#gap", {}), k, Node("#gap", {}))]
            elif tag in ("mfrac", "mtr"):
                kids = [x for k in kids for x in (k, Node("#gap", {}))]
            elif tag == "#gap":
                page.put(" ", False)
            elif tag in ("option", "optgroup") and node.attrs.get("label"):
                page.end(0)
                page.put(node.attrs["label"], False)
                kids = [] if tag == "option" else kids
            if tag == "details" and "open" not in node.attrs:
                kids = [k for k in kids if isinstance(k, Node) and k.tag == "summary"][:1]
            if tag in ("table", "li", "td", "th", "blockquote", "dd"):
                pages.append(Page(tag == "table"))
            elif tag == "tr":
                page.rows.append([])
            elif tag in BLOCK:
                page.end(int(tag in SPACED and not (tag in ("ul", "ol") and counters)))
                pre += tag == "pre"
                if tag in ("ul", "ol", "menu"):
                    start = node.attrs.get("start", "1")
                    counters.append(int(start) if tag == "ol" and re.fullmatch(r"-?\d{1,9}", start) else 1 if tag == "ol" else None)
            elif tag == "q":
                page.put('"', False)
            todo += [(k, True) for k in reversed(kids)]
            continue
        if tag == "table":
            inner = pages.pop()
            pages[-1].block(inner.done() + lay_out(inner.rows), 1)
        elif tag in ("td", "th"):
            lines = pages.pop().done()
            if not pages[-1].rows:
                pages[-1].rows.append([])
            span = node.attrs.get("colspan", "1")
            pages[-1].rows[-1] += [lines] + [[]] * (min(int(span), 1000) - 1 if re.fullmatch(r"[1-9]\d{0,5}", span) else 0)
        elif tag == "li":
            mark = "- "
            if counters and counters[-1] is not None:
                mark = f"{counters[-1]}. "
                counters[-1] += 1
            lines = pages.pop().done()
            pages[-1].block([(mark if i == 0 else " " * len(mark) if x else "") + x for i, x in enumerate(lines)], 0)
        elif tag in ("blockquote", "dd"):
            lines = pages.pop().done()
            pages[-1].block([("  " if tag == "dd" else "> ") + x if x else x for x in lines], int(tag == "blockquote"))
        elif tag in BLOCK and tag != "tr":
            nested = False
            if tag in ("ul", "ol", "menu"):
                counters.pop()
                nested = bool(counters)
            pre -= tag == "pre"
            page.end(int(tag in SPACED and not nested))
        elif tag == "q":
            page.put('"', False)
    return "\n".join(pages[0].done()).replace("\xa0", " ")


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_chars) for each row of ``pages(page_id, html)``.

    Null or empty html gives an empty text. Repeated rows give repeated rows; an empty
    table gives an empty result; other columns are ignored. A page is handled whole, in
    time and memory proportional to its size.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page_id": batch["page_id"], "text": [render(h) for h in batch["html"]]})

    return map_rows(pages.select("page_id", "html"), run, "page_id long, text string", "page_id").withColumn("n_chars", F.length("text").cast("long"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
