"""HTML to text the way a page is laid out: a tree with implied tags, visibility, blocks, lists, tables."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Generator, Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements that are not drawn where they stand, inside the element of the key.
NOT_DRAWN = {"svg": set("title desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter".split()), "math": set("annotation annotation-xml mphantom".split())}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("head title script style template noscript iframe object applet canvas audio video datalist meta link base noembed noframes".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol menu dl table blockquote pre hr figure fieldset article section".split())
BLOCK = SPACED | set("address aside body center dd details dialog dir div dt figcaption footer form header hgroup html legend li main nav search summary caption thead tbody tfoot tr td th option optgroup text".split())  # text is one of svg
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: An opening tag ends these open elements, looking up as far as one of the second set.
ENDS: dict[str, tuple[set[str], set[str]]] = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "tr"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "tr"}, {"table"}),
    "option": ({"option"}, {"select", "table"}),
    "optgroup": ({"optgroup", "option"}, {"select", "table"}),
    "body": ({"head"}, set()),
}
CLOSE_P = (BLOCK - {"li", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "option", "optgroup", "html", "body", "text"}) | {"li", "dd", "dt"}
INSIDE_HEAD = set("title meta link style script base noscript template".split())
TABLE_PARTS = set("table thead tbody tfoot tr td th caption li".split())  # laid out by their place, whatever their style says
DISPLAY, VISIBILITY = (re.compile(rf"(?:^|[;{{\s]){name}\s*:\s*([a-z-]+)", re.I) for name in ("display", "visibility"))
INLINE = set("inline inline-block inline-flex inline-grid inline-table contents ruby".split())
SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")
SILENT = set("hidden password checkbox radio file image color range".split())  # inputs whose value is not read as text
BLANKS = re.compile(r"[ \t\n\r\f]+")
DEEPEST = 150  # blocks nested deeper are not indented or aligned any more
WIDEST = 60  # a cell wider than this does not widen its column
COLUMNS = 1000  # columns beyond this are not kept free below a cell of several rows


class Node:
    __slots__ = ("tag", "attrs", "children", "gone", "block")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs = tag, attrs
        self.children: list[Node | str] = []
        self.gone, self.block = False, tag in BLOCK


class Tree(HTMLParser):
    """Builds the tree: void elements, elements that end by implication, stray end tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.at: dict[str, list[int]] = defaultdict(list)  # places of each tag among the open elements

    def nearest(self, *tags: str) -> int:
        """The place of the innermost open element of these tags, 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at[t]), default=0)

    def push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.open))
        self.open.append(node)

    def close_from(self, place: int) -> None:
        while len(self.open) > place:
            self.at[self.open.pop().tag].pop()

    def handle_starttag(self, tag, attrs):
        if tag == "html" or (tag == "body" and self.at[tag]):
            return
        if self.open[-1].tag == "head" and tag not in INSIDE_HEAD:
            self.close_from(len(self.open) - 1)  # the body begins where the head ends
        if tag in ENDS:
            ended, border = ENDS[tag]
            low = self.nearest(*border)
            above = [places[k] for t in ended if (k := bisect_right(places := self.at[t], low)) < len(places)]
            self.close_from(min(above, default=len(self.open)))
        if tag in CLOSE_P and (at := self.nearest("p")) > self.nearest("td", "th", "table", "button"):
            self.close_from(at)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.close_from(len(self.open) - 1)
        node = Node(tag, {k: v or "" for k, v in attrs})
        if any(self.at[kind] and tag in tags for kind, tags in NOT_DRAWN.items()):
            node.attrs["hidden"] = ""
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.push(node)
        elif tag == "input" and node.attrs.get("type", "text").lower() not in SILENT and node.attrs.get("value"):
            node.children.append(f" {node.attrs['value']} ")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML
        if self.nearest("svg", "math") > self.nearest("foreignobject") and self.open[-1].tag == tag:
            self.close_from(len(self.open) - 1)  # but it closes drawings and formulas

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag("br", [])
        if tag in ("html", "body"):
            return
        at = self.nearest(tag)
        # a stray end tag in a cell does not reach out of it
        if at and (tag in ("tr", "table", "tbody", "thead", "tfoot") or at >= self.nearest("td", "th", "table")):
            self.close_from(at)

    def handle_data(self, data):
        if self.open[-1].tag == "head":
            if not data.strip():
                return
            self.close_from(len(self.open) - 1)
        self.open[-1].children.append(data)

    def parse_marked_section(self, i, report=1):
        """A bracketed declaration is a broken comment, up to the next >."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1


def tree(html: str) -> Node:
    parser = Tree()
    parser.feed(html)
    parser.close()
    settle(parser.root, "<style" in html.lower())
    return parser.root


def declared(style: str) -> tuple[str | None, str | None]:
    """(display, visibility) of a list of declarations; the last one counts."""
    return tuple(found[-1].lower() if (found := kind.findall(style)) else None for kind in (DISPLAY, VISIBILITY))


class Sheet:
    """The rules of a page's own style sheets that show or hide: plain selectors of tag, class and id."""

    def __init__(self, css: str):
        self.rules: dict[str, list[tuple[int, str, set[str], tuple[str | None, str | None]]]] = defaultdict(list)
        css = re.sub(r"/\*.*?\*/", " ", css, flags=re.S)
        at = 0
        while (start := css.find("{", at)) >= 0:
            selectors, at = css[at:start], start + 1
            if selectors.rsplit(";", 1)[-1].lstrip(" \t\r\n\f}").startswith("@"):  # a rule for some media
                deep = 1
                while deep and at < len(css):
                    deep += {"{": 1, "}": -1}.get(css[at], 0)
                    at += 1
                continue
            end = css.find("}", at)
            body, at = css[at : end if end >= 0 else len(css)], end + 1 if end >= 0 else len(css)
            found = declared(body)
            if any(found):
                for selector in selectors.rsplit(";", 1)[-1].lstrip("} \t\r\n\f").split(","):
                    self.add(selector.strip(), found)

    def add(self, selector: str, found: tuple[str | None, str | None]) -> None:
        match = SIMPLE.fullmatch(selector)
        if match and selector:
            tag, marks = (match[1] or "").lower().strip("*"), set(re.findall(r"[.#][\w-]+", match[2]))
            weight = sum(100 if m[0] == "#" else 10 for m in marks) + bool(tag)
            self.rules[min(marks) if marks else tag].append((weight, tag, marks, found))

    def of(self, node: Node) -> tuple[str | None, str | None]:
        marks = {"." + c for c in node.attrs.get("class", "").split()} | ({"#" + node.attrs["id"]} if "id" in node.attrs else set())
        fits = [r for key in (*marks, node.tag, "") for r in self.rules.get(key, ()) if r[1] in ("", node.tag) and r[2] <= marks]
        display = visibility = None
        for _, _, _, (d, v) in sorted(fits, key=lambda r: r[0]):  # of equal weight the later one
            display, visibility = d or display, v or visibility
        return display, visibility


def settle(root: Node, styled: bool) -> None:
    """Mark what is not drawn and what is a block, and drop texts whose visibility is hidden.

    Visibility is inherited, so a visible element in a hidden one is seen; display is not.
    """
    sheet = Sheet("\n".join(styles(root))) if styled else None
    left = [(root, False)]
    while left:
        node, silent = left.pop()
        display = visibility = None
        if sheet:
            display, visibility = sheet.of(node)
        if "style" in node.attrs:
            d, v = declared(node.attrs["style"])
            display, visibility = d or display, v or visibility
        closed = node.tag == "dialog" and "open" not in node.attrs
        node.gone = node.tag in HIDDEN or closed or display == "none" or ("hidden" in node.attrs and not display)
        if node.gone:
            continue
        if display and node.tag not in TABLE_PARTS:
            node.block = display not in INLINE
        silent = visibility in ("hidden", "collapse") if visibility and visibility != "inherit" else silent
        if silent:
            node.children = [c for c in node.children if isinstance(c, Node)]
        left += [(c, silent) for c in node.children if isinstance(c, Node)]


def styles(root: Node) -> Iterator[str]:
    left = [root]
    while left:
        node = left.pop()
        if node.tag == "style":
            yield "".join(c for c in node.children if isinstance(c, str))
        left += [c for c in reversed(node.children) if isinstance(c, Node)]


def visible(node: Node) -> bool:
    return not node.gone


def shown(node: Node) -> list[Node | str]:
    """The children that are seen: of closed details only the summary."""
    if node.tag == "details" and "open" not in node.attrs:
        return [c for c in node.children if isinstance(c, Node) and c.tag == "summary"]
    return node.children


def inside(node: Node) -> Iterator[Node | str]:
    """Texts, line breaks and blocks in order; inline elements are dissolved."""
    left = [iter(shown(node))]
    while left:
        child = next(left[-1], None)
        if child is None:
            left.pop()
        elif isinstance(child, str):
            yield child
        elif visible(child):
            if child.tag == "br" or child.block:
                yield child
            else:
                left.append(iter(shown(child)))


#: A layout that yields the layouts of the blocks in it and returns its lines.
Layout = Generator["Layout", list[str], list[str]]


def lay_out(layout: Layout) -> list[str]:
    """The lines of a layout; nested blocks stand on a stack, not in calls."""
    stack, lines = [layout], None
    while stack:
        try:
            stack.append(stack[-1].send(lines))
            lines = None
        except StopIteration as done:
            stack.pop()
            lines = done.value
    return lines


def flow(node: Node, tight: bool = False, depth: int = 0) -> Layout:
    """The lines of an element's content. Blocks get lines of their own, spaced ones a blank line around."""
    lines: list[str] = []
    words: list[str] = []
    gap = False

    def flush(always: bool = False) -> None:
        nonlocal gap
        text = BLANKS.sub(" ", "".join(words)).strip(" ")
        words.clear()
        if text or always:
            if gap and lines:
                lines.append("")
            lines.append(text)
            gap = False

    for part in inside(node):
        if isinstance(part, str):
            words.append(part)
        elif part.tag == "br":
            flush(always=True)
        else:
            flush()
            block = yield render(part, tight, depth + 1)
            spaced = part.tag in SPACED and not tight
            if block:
                if (gap or spaced) and lines and lines[-1]:
                    lines.append("")
                if lines:
                    lines += block
                else:
                    lines = block
                gap = spaced
            elif spaced:
                gap = bool(lines)
    flush()
    while lines and not lines[-1]:
        lines.pop()
    return lines


def render(node: Node, tight: bool, depth: int) -> Layout:
    if node.tag in ("ul", "ol", "menu", "dir"):
        return (yield listing(node, depth))
    if node.tag == "table":
        return (yield grid(node, depth))
    if node.tag == "pre":
        text = raw(node)
        return text.removeprefix("\n").rstrip().split("\n") if text.strip() else []
    lines = yield flow(node, tight, depth)
    if node.tag in ("blockquote", "dd") and depth < DEEPEST:
        return ["    " + x if x else x for x in lines]
    return lines


def raw(node: Node) -> str:
    """Texts as they stand; a block in them has lines of its own, and cells of a row stand apart."""
    out: list[str] = []
    left: list[tuple[Node, Iterator[Node | str]]] = [(node, iter(shown(node)))]

    def new_line() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    while left:
        parent, children = left[-1]
        child = next(children, None)
        if child is None:
            left.pop()
            if left and parent.block and parent.tag not in ("td", "th"):
                new_line()
        elif isinstance(child, str):
            out.append(child) if child else None
        elif child.tag == "br":
            out.append("\n")
        elif visible(child):
            if child.tag in ("td", "th"):
                out += ["  "] if out and not out[-1].endswith("\n") else []
            elif child.block:
                new_line()
            left.append((child, iter(shown(child))))
    return "".join(out)


def letters_of(number: int) -> str:
    """a, b, ... z, aa, ab, ..."""
    out = ""
    while number > 0:
        number, digit = divmod(number - 1, 26)
        out = chr(97 + digit) + out
    return out


def roman(number: int) -> str:
    out = ""
    for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += sign * (number // value)
        number %= value
    return out


def numbered(number: int, kind: str) -> str:
    """The number of a list item in the list's style; numbers that a style cannot write stay plain."""
    if kind in ("a", "A") and number > 0:
        text = letters_of(number)
    elif kind in ("i", "I") and 0 < number < 4000:
        text = roman(number)
    else:
        return f"{number}. "
    return (text.upper() if kind.isupper() else text) + ". "


def whole(value: str | None) -> int | None:
    return int(value) if value and re.fullmatch(r"\s*[+-]?[0-9]{1,9}\s*", value) else None


def listing(node: Node, depth: int) -> Layout:
    """Items with a dash or their number; what follows in an item is indented."""
    lines: list[str] = []
    parts = list(inside(node))
    step = -1 if "reversed" in node.attrs else 1
    first = whole(node.attrs.get("start"))
    number = first if first is not None else 1 if step > 0 else sum(isinstance(p, Node) and p.tag == "li" for p in parts)
    for part in parts:
        if isinstance(part, str):
            lines += [t] if (t := BLANKS.sub(" ", part).strip(" ")) else []
            continue
        if part.tag != "li":
            block = yield render(part, True, depth + 1)
            lines += ["  " + x if x and depth < DEEPEST else x for x in block]
            continue
        own = whole(part.attrs.get("value"))
        number = own if own is not None and node.tag == "ol" else number
        mark = numbered(number, part.attrs.get("type", node.attrs.get("type", "1"))) if node.tag == "ol" else "- "
        number += step
        item = yield flow(part, True, depth + 1)
        lines += [(mark if i == 0 else " " * len(mark) if depth < DEEPEST else "") + x for i, x in enumerate(item)]
    return lines


def places_of(text: str) -> int:
    """The width of a text in places of a fixed-width font: wide letters take two, marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def grid(node: Node, depth: int) -> Layout:
    """A caption and what stands between cells, then the rows with their columns aligned two spaces apart."""
    before: list[str] = []
    rows: list[list[tuple[list[str], int, int]]] = []  # lines, first column, number of columns

    def loose(words: list[str]) -> None:
        before.extend([t] if (t := BLANKS.sub(" ", "".join(words)).strip(" ")) else [])
        words.clear()

    def line(cells: list[Node], taken: dict[int, float]) -> Layout:
        """A row beside the cells that reach down into it: `taken` has the row after their last one by column."""
        row, at = [], 0
        for cell in cells:
            while taken.get(at, 0) > len(rows):
                at += 1
            wide, down = span(cell), height(cell)
            row.append(((yield flow(cell, True, depth + 1)) or [""], at, wide))
            if down > 1:
                for column in range(at, min(at + wide, COLUMNS)):
                    taken[column] = max(taken.get(column, 0), len(rows) + down)
            at += wide
        rows.append(row)
        return []

    def collect(part: Node) -> Layout:
        taken: dict[int, float] = {}
        for child in inside(part):
            if isinstance(child, str):
                loose([child])
            elif child.tag == "tr":
                cells, words = [], []
                for c in inside(child):
                    if isinstance(c, str):
                        words.append(c)
                    else:
                        loose(words)
                        cells += [c] if c.tag != "br" else []
                loose(words)
                yield line(cells, taken)
            elif child.tag in ("thead", "tbody", "tfoot"):
                taken = {}  # no cell reaches out of its part of the table
                yield collect(child)
            elif child.tag in ("td", "th"):  # a cell without its row
                yield line([child], taken)
            else:
                before.extend((yield render(child, True, depth + 1)))
        return []

    yield collect(node)
    if depth >= DEEPEST:
        return before + [x for row in rows for lines, *_ in row for x in lines if x]
    widths: dict[int, int] = {}
    for row in rows:
        for lines, at, wide in row:
            if wide == 1:
                longest = max(map(places_of, lines))
                widths[at] = max(widths.get(at, 0), longest if longest <= WIDEST else 0)
    columns = max((at + wide for row in rows for _, at, wide in row), default=0)
    places = [0, *accumulate(widths.get(c, 0) + 2 for c in range(columns))]
    out = before
    for row in rows:
        for i in range(max((len(lines) for lines, *_ in row), default=0)):
            text = ""
            for lines, at, _ in row:
                free = places[at] - places_of(text)
                text += " " * (free if free >= 0 else 2)
                text += lines[i] if i < len(lines) else ""
            if text.strip():
                out.append(text.rstrip())
    return out


def height(cell: Node) -> float:
    """The number of rows a cell reaches over; 0 is all that follow."""
    value = cell.attrs.get("rowspan", "1")
    return int(value) or float("inf") if re.fullmatch(r"\d{1,6}", value, re.ASCII) else 1


def span(cell: Node) -> int:
    value = cell.attrs.get("colspan", "1")
    return max(1, min(COLUMNS, int(value))) if re.fullmatch(r"[0-9]{1,6}", value) else 1  # the standard's own bound


def text_of(html: str | None) -> str:
    return "\n".join(lay_out(flow(tree(html)))) if html else ""


def extract_text(pages: DataFrame) -> DataFrame:
    """Adds `text`: what a reader of the page `html` sees, laid out in lines.

    Elements that are never shown (head, scripts, styles, templates, `hidden`, display none,
    closed dialogs, the inside of closed details) are left out, and texts whose visibility is
    hidden; a `style` attribute counts, and so do rules of the page's own style sheets with
    selectors of tag, class and id. Blocks stand on lines of
    their own, paragraphs, headings, lists and tables with a blank line around; list items
    have a dash or their number in the list's style; values of inputs are read; table cells are aligned, below a cell of several rows its columns
    stay free, and text between cells stands before the rows; preformatted text keeps its blanks.
    Null and empty pages give an empty text, text without markup itself. Broken markup is
    read by the rules of implied and stray tags; nothing raises. Elements may be nested to
    any depth; blocks more than 150 deep are not indented, tables there not aligned. Repeated rows give repeated results, an empty table an
    empty one; a column `text` is replaced. Each page is read whole, where it lies.
    """

    @F.pandas_udf(T.StringType())
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([text_of(h) for h in pages], dtype=object)

    return pages.withColumn("text", extract("html"))
