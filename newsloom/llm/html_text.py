"""Visible text of web pages with its layout.

A page becomes a tree: tags that the author left out are implied, end tags close what they
may close. A walk over the tree drops what a browser does not show and writes the rest:
blanks collapse, blocks stand on lines of their own, paragraphs and tables are set apart by
an empty line, list items carry their mark and depth, table cells stand in columns. Neither
the builder nor the walk recurses, so that depth has no limit. Blanks that set text in
columns or in depth are bounded in front of each piece of text, so that a page's text is at
most a small multiple of the page; no text is left out for that.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import column

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_BLANKS = re.compile(r"[ \t\n\r\f]+")
_NO_BOX = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|initial|hidden|collapse)\b", re.I)
#: What begins a tag. Behind the last `>` of a page nothing ends it, and a browser shows no more.
_BEGUN = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
#: The end of a tag whose slash belongs to a value without quotes.
_SLASH_IN_VALUE = re.compile(r"""=\s*[^\s"'=<>`]+\Z""")

#: Fixed names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_NEVER_SHOWN = frozenset(
    "head script style title template noscript noembed noframes iframe object audio video canvas datalist "
    "meta link base param".split()
)
#: What is never drawn by itself inside svg and math.
_NEVER_DRAWN = {
    "svg": frozenset(
        "defs desc metadata symbol clippath mask marker pattern lineargradient radialgradient filter".split()
    ),
    "math": frozenset("annotation annotation-xml".split()),
}
#: Labels of drawings and rows of formulas, which stand on lines of their own.
_DRAWN_LINES = frozenset("text foreignobject mtr".split())
_HTML_INSIDE = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
_APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr".split())
_BLOCK = _APART | frozenset(
    "html body address article aside caption center dd details dialog dir div dt fieldset figcaption footer form header "
    "hgroup legend li main menu nav section summary tbody td tfoot th thead tr search optgroup option".split()
)
_CLOSE_P = _BLOCK - frozenset("html body caption dd dt legend li summary tbody td tfoot th thead tr option optgroup".split()) | {
    "li", "dd", "dt", "summary"
}
#: What a start tag closes, and inside which open tags this stops.
_IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
_HEAD_ONLY = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
_SCOPE = frozenset("table td th caption html button object".split())

#: Widest cell line that others are aligned with, most blanks in front of a piece of text,
#: deepest indent, and tables inside each other that are set in columns.
WIDEST, GAP, DEEPEST, NESTED = 60, 120, 20, 64


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


class Builder:
    """Tree of a page. Texts are strings among the children, with references decoded."""

    def __init__(self) -> None:
        self.root = Node("html", {})
        self.drawings = False
        self.open = [self.root]
        self.names: Counter[str] = Counter()  # of the open tags

    def build(self, page: str) -> Node:
        at, last = 0, page.rfind(">")
        while at <= last and (m := _TAG.search(page, at)) is not None and m.start() < last:
            if m.start() > at:
                self.text(html.unescape(page[at : m.start()]))
            at = m.end()
            name = m[2]
            if not name:
                continue
            name = name.lower()
            if m[1]:
                self.end(name)
                continue
            self.start(name, m[3])
            if name not in _VOID and m[3].endswith("/") and not _SLASH_IN_VALUE.search(m[3]) and self._drawing():
                self._close(-1)
                continue
            if name in _RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)|\Z", re.I).search(page, at)
                inside = page[at : close.start()]
                if name == "textarea":
                    inside = html.unescape(inside)
                self.open[-1].children.append(inside)
                self._close(-1)
                at = close.end()
        begun = _BEGUN.search(page, at)
        if at < (end := begun.start() if begun else len(page)):
            self.text(html.unescape(page[at:end]))
        return self.root

    def _close(self, i: int) -> None:
        """Close the open tags from place `i` on."""
        self.names.subtract(node.tag for node in self.open[i:])
        del self.open[i:]

    def text(self, text: str) -> None:
        if text.strip(" \t\n\r\f"):
            self._leave_head()
        self.open[-1].children.append(text)

    def _leave_head(self) -> None:
        if len(self.open) > 1 and self.open[1].tag == "head":
            self._close(1)

    def _depth(self, names, stop) -> int | None:
        """Place of the outermost open tag of `names` inside the innermost of `stop`."""
        found = None
        if not any(self.names[name] for name in names):
            return None
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in stop:
                break
            if tag in names:
                found = i
        return found

    def _drawing(self) -> bool:
        """Whether the innermost open tag is one of svg or math, where a slash ends it."""
        if not self.drawings:
            return False
        if self.open[-1].tag in ("svg", "math"):
            return True
        for node in reversed(self.open[:-1]):
            if node.tag in ("svg", "math"):
                return True
            if node.tag in _HTML_INSIDE:
                return False
        return False

    def start(self, name: str, source: str) -> None:
        attributes = _attributes(source) if source and not source.isspace() else {}
        if name in ("html", "body") and (name == "html" or self.names["body"] > 0):
            return
        if name not in _HEAD_ONLY:
            self._leave_head()
        if name in _CLOSE_P and (i := self._depth({"p"}, _SCOPE)) is not None:
            self._close(i)
        if name in _IMPLIED_END:
            names, stop = _IMPLIED_END[name]
            if (i := self._depth(names, stop)) is not None:
                self._close(i)
        if name in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self._push(Node("tr", {}))
        self.drawings = self.drawings or name in ("svg", "math")
        node = Node(name, attributes)
        if name in _VOID:
            self.open[-1].children.append(node)
        else:
            self._push(node)

    def _push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self.open.append(node)
        self.names[node.tag] += 1

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", "")
            return
        for i in range(len(self.open) - 1, 0, -1) if self.names[name] > 0 else ():
            tag = self.open[i].tag
            if tag == name:
                self._close(i)
                return
            if tag in _SCOPE and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                return
            if tag == "table" and name != "table":
                return


def shown(node: Node, realm: str = "") -> bool:
    """Whether a node has a place on the page; `realm` is svg or math inside of these."""
    a = node.attributes
    return not (
        node.tag in _NEVER_SHOWN
        or (realm and node.tag in _NEVER_DRAWN[realm])
        or "hidden" in a
        or (node.tag == "dialog" and "open" not in a)
        or ("style" in a and _NO_BOX.search(a["style"]))
    )


def visible(node: Node, above: bool) -> bool:
    """Whether the node's own text is seen, given that of its parent is."""
    style = node.attributes.get("style")
    told = _VISIBILITY.findall(style) if style else []
    return told[-1].lower() in ("visible", "initial") if told else above


def _seen_children(node: Node) -> list[Node | str]:
    """Of a closed `details` only its summary is seen."""
    if node.tag == "details" and "open" not in node.attributes:
        return [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
    return node.children


def _leading(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


class _Page:
    """Lines being written. `gap` is how many line ends are due before the next text."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.gap, self.blank, self.mark = 0, False, ""
        self.indent = 0

    def block(self, gap: int) -> None:
        self.gap, self.blank = max(self.gap, gap), False

    def _begin(self) -> None:
        if self.gap and self.parts:
            self.parts.append("\n" * self.gap)
        if self.gap or not self.parts:
            self.parts.append("  " * min(max(self.indent - bool(self.mark), 0), DEEPEST) + self.mark)
            self.mark = ""
        elif self.blank:
            self.parts.append(" ")
        self.gap, self.blank = 0, False

    def inline(self, text: str) -> None:
        text = _BLANKS.sub(" ", text)
        core = text.strip(" ")
        if not core:
            self.blank = self.blank or bool(text)
            return
        self.blank = self.blank or text[0] == " "
        self._begin()
        self.parts.append(core)
        self.blank = text[-1] == " "

    def lines(self, lines: list[str]) -> None:
        self._begin()
        indent = 2 * min(self.indent, DEEPEST)
        first, *rest = lines
        self.parts.append("\n".join([first, *(" " * min(indent, max(GAP - _leading(x), 0)) + x for x in rest)]))
        self.block(1)

    def text(self) -> str:
        return "".join(self.parts)


def aligned(rows: list[list[tuple[str, int]]]) -> list[str]:
    """Rows of (cell text, columns spanned) as lines with columns two blanks apart. A column
    is as wide as its longest cell line of at most WIDEST characters; behind a longer one
    the row goes on two blanks further. At most GAP blanks stand in front of any text."""
    widths: dict[int, int] = {}
    for row in rows:
        at = 0
        for text, span in row:
            widths.setdefault(at, 0)
            if span == 1:
                widths[at] = max([widths[at], *(n for n in map(len, text.split("\n")) if n <= WIDEST)])
            at += span
    places, total = {}, 0
    for at in sorted(widths):
        places[at] = total
        total += widths[at] + 2
    lines = []
    for row in rows:
        pieces: list[list[tuple[int, str]]] = []
        at = 0
        for text, span in row:
            for k, piece in enumerate(text.split("\n") if text else ()):
                if k == len(pieces):
                    pieces.append([])
                if piece:
                    pieces[k].append((places[at], piece))
            at += span
        for line in pieces:
            parts, length = [], 0
            for place, piece in line:
                gap = min(max(place - length, 2 if parts else 0), max(GAP - _leading(piece), 0))
                parts.append(" " * gap + piece)
                length += gap + len(piece)
            lines.append("".join(parts).rstrip())
    return [line for line in lines if line]


def _span(node: Node, name: str) -> int:
    value = node.attributes.get(name, "1").strip()
    return min(max(int(value), 1), 1000) if value.isascii() and value.isdigit() else 1


def render(root: Node) -> str:
    page = _Page()
    pages, tables, lists, pre = [], [], [], 0
    plain = 0  # open tables that lie too deep for columns
    # (node, entering, whether its text is seen, svg or math around it)
    stack: list[tuple[Node | str, bool, bool, str]] = [(root, True, True, "")]
    while stack:
        node, entering, seen, realm = stack.pop()
        if isinstance(node, str):
            if not seen:
                continue
            if pre:
                first, *rest = node.split("\n")
                if first:
                    page._begin()
                    page.parts.append(first)
                for line in rest:
                    page.parts.append("\n" + "  " * min(page.indent, DEEPEST) + line)
                page.blank = False
            else:
                page.inline(node)
            continue
        tag = node.tag
        if entering:
            if not shown(node, realm):
                continue
            seen = visible(node, seen)
            if tag == "br":
                if page.gap < 2 and page.parts:
                    page.gap, page.blank = page.gap + 1, False
                continue
            if tag in _BLOCK:
                page.block(1 if lists and tag in ("ul", "ol") else 2 if tag in _APART else 1)
            elif realm and tag in _DRAWN_LINES:
                page.block(1)
            elif tag == "mtd":
                page.blank = True
            if tag in _VOID:
                continue
            if tag in ("ul", "ol", "menu", "dir"):
                start = node.attributes.get("start", "1").strip()
                lists.append(int(start) if tag == "ol" and re.fullmatch(r"-?[0-9]{1,9}", start) else 1 if tag == "ol" else None)
                page.indent += 1
            elif tag == "li":
                number = lists[-1] if lists else None
                page.mark = "" if not seen else "- " if number is None else f"{number}. "
                if number is not None:
                    lists[-1] += 1
            elif tag in ("dd", "blockquote"):
                page.indent += 1
            elif tag == "pre":
                pre += 1
            elif tag == "table":
                if plain or len(tables) == NESTED:
                    plain += 1
                else:
                    tables.append(([], {}, [0]))
            elif plain and tag in ("td", "th"):
                page.blank = True
            elif plain:
                pass
            elif tag == "tr" and tables:
                tables[-1][0].append([])
                tables[-1][2][0] = 0
            elif tag in ("td", "th") and tables:
                pages.append((page, lists, pre))
                page, lists, pre = _Page(), [], 0
            elif tag == "caption" and tables:
                pages.append((page, lists, pre))
                page, lists, pre = _Page(), [], 0
            stack.append((node, False, seen, realm))
            if tag in ("svg", "math"):
                realm = tag
            elif tag == "foreignobject":
                realm = ""
            label = node.attributes.get("label") if tag in ("option", "optgroup") else None
            if label and seen:
                page.inline(label)
                page.block(1)
            if not (label and tag == "option"):
                stack.extend((child, True, seen, realm) for child in reversed(_seen_children(node)))
            continue
        if tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
            page.indent -= 1
        elif tag in ("dd", "blockquote"):
            page.indent -= 1
        elif tag == "li":
            page.mark = ""
        elif tag == "pre":
            pre -= 1
        elif tag == "table" and plain:
            plain -= 1
        elif plain:
            pass
        elif tag == "caption" and tables:
            text = page.text()
            page, lists, pre = pages.pop()
            if text:
                page.lines(text.split("\n"))
        elif tag in ("td", "th") and tables:
            text = page.text()
            page, lists, pre = pages.pop()
            rows, held, place = tables[-1]
            row = rows[-1] if rows else rows.append([]) or rows[-1]
            at = place[0]
            # cells of rows above that reach down: first column -> (columns, last row)
            while at in held and held[at][1] >= len(rows):
                row.append(("", held[at][0]))
                at += held[at][0]
            across, down = _span(node, "colspan"), _span(node, "rowspan")
            row.append((text, across))
            place[0] = at + across
            if down > 1:
                held[at] = (across, len(rows) - 1 + down)
        elif tag == "table" and tables:
            rows, _, _ = tables.pop()
            if lines := aligned([row for row in rows if row]):
                page.lines(lines)
        if tag in _BLOCK:
            page.block(1 if lists and tag in ("ul", "ol") else 2 if tag in _APART else 1)
        elif realm and tag in _DRAWN_LINES:
            page.block(1)
    return page.text()


def page_text(page: str | None) -> str:
    """Visible text of a page; a null or empty page has none."""
    return render(Builder().build(page)) if page else ""


def _texts(pages: pd.Series) -> pd.Series:
    return pd.Series([page_text(p) for p in pages], dtype=object)


def visible_text(page: Column) -> Column:
    return F.pandas_udf(_texts, "string")(page)


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per row of `pages`: page_id, text. Null and empty pages give an empty text.
    Repeated rows and null ids pass through. An empty table gives an empty result. Other
    columns are not looked at."""
    return pages.select(column(id_col).alias("page_id"), visible_text(column(html_col)).alias("text"))
