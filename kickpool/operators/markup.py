"""HTML reader used inside tasks: one page in, its table rows, links or text out.

One pass splits a page into tags and text and keeps a stack of open elements, supplying the
structure a browser would where tables are concerned: omitted section and row tags are
added, and content stranded between cells moves in front of its table. A second pass numbers
elements and texts in document order, so the text and the descendants of any element are
slices of flat lists and nested markup is never walked again.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

from kickpool.functions.text import WS

SPACES = re.compile(WS + "+")
# Inside tags only five ASCII blanks separate; any other white space belongs to a name or value.
# A comment, a tag with its attributes, some other declaration, or a tag cut off by the end.
MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\t\n\f\r />]*)"
    r"((?:=[\t\n\f\r ]*+(?:\"[^\"]*+\"|'[^']*+'|[^\t\n\f\r >]*+)|[^>=]++)*+)>"
    r"|<(?:[!?]|/[^a-zA-Z])[^>]*>"
    r"|</?[a-zA-Z].*\Z|<[!?].*\Z",
    re.S,
)
ATTRIBUTE = re.compile(
    r"([^\t\n\f\r />=]+)(?:[\t\n\f\r ]*=[\t\n\f\r ]*(\"[^\"]*\"|'[^']*'|[^\t\n\f\r >]+))?"
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style noscript iframe noembed noframes xmp".split())
NO_TAGS_INSIDE = RAW_TEXT | {"title", "textarea"}
SECTIONS = ("tbody", "thead", "tfoot")
CELLS = ("td", "th")
# The open elements a table part may be put into; whatever is open above them ends first.
HOSTS = dict.fromkeys((*SECTIONS, "caption", "colgroup"), ("table",))
HOSTS |= {"tr": ("table", *SECTIONS), "td": ("table", *SECTIONS, "tr")}
HOSTS["th"] = HOSTS["td"]
USUAL_HOST = dict.fromkeys((*SECTIONS, "caption", "colgroup"), "table")
USUAL_HOST |= {"tr": "tbody", "td": "tr", "th": "tr"}
BETWEEN_CELLS = frozenset(("table", "tr", *SECTIONS))
SCOPE_END = ("table", "caption", *CELLS)
STAY_IN_TABLE = frozenset((*HOSTS, "script", "style", "template", "col", "form"))
LISTED = {"table": "table", "tr": "tr", "td": "cell", "th": "cell", "a": "a", "span": "span"}


def squeeze(text: str) -> str:
    return SPACES.sub(" ", text).strip(" ")


class Element:
    __slots__ = ("attrs", "children", "end", "in_body", "parent", "place", "table", "tag", "words")

    def __init__(self, tag: str, parent: Element | None = None, attrs: str = ""):
        self.tag = tag
        self.parent = parent
        self.attrs = attrs
        self.children: list[Element | str] = []

    def attributes(self) -> Iterator[tuple[str, str]]:
        for name, value in ATTRIBUTE.findall(self.attrs):
            if value[:1] in ("'", '"'):
                value = value[1:-1]
            yield name.lower(), unescape(value)

    def inner_html(self, limit: int) -> str:
        """The first ``limit`` characters of the serialised children."""
        out, size = [], 0
        stack: list = self.children[::-1]
        while stack and size < limit:
            node = stack.pop()
            if isinstance(node, Element):
                attrs = "".join(f' {k}="{_escape(v, True)}"' for k, v in node.attributes())
                piece = f"<{node.tag}{attrs}>"
                if node.tag not in VOID:
                    stack.append((f"</{node.tag}>",))
                    raw = node.tag in RAW_TEXT
                    stack.extend((c,) if raw else c for c in reversed(node.children))
            else:
                piece = node[0] if isinstance(node, tuple) else _escape(node, False)
            out.append(piece)
            size += len(piece)
        return "".join(out)[:limit]


def _escape(text: str, in_attribute: bool) -> str:
    text = text.replace("&", "&amp;").replace("\u00a0", "&nbsp;")
    if in_attribute:
        return text.replace('"', "&quot;")
    return text.replace("<", "&lt;").replace(">", "&gt;")


class Page:
    """Element tree of a page with its elements and texts in document order."""

    def __init__(self, html: str):
        self.root = Element("#document")
        self.open = [self.root]
        self._read(html)
        self.texts: list[str] = []
        self.found: dict[str, list[Element]] = {name: [] for name in LISTED.values()}
        self._number()
        self.places = {name: [e.place for e in es] for name, es in self.found.items()}

    # ------------------------------------------------------------------------- queries

    def text(self, element: Element) -> str:
        first, last = element.words
        return squeeze("".join(self.texts[first:last]))

    def whole_text(self) -> str:
        return squeeze("".join(self.texts))

    def within(self, element: Element, name: str) -> list[Element]:
        """Descendants of one kind in document order."""
        places = self.places[name]
        first = bisect_left(places, element.place + 1)
        return self.found[name][first : bisect_left(places, element.end)]

    # ------------------------------------------------------------------------ building

    def _read(self, html: str) -> None:
        at = 0
        open_elements, search = self.open, MARKUP.search
        while (hit := search(html, at)) is not None:
            start = hit.start()
            if start > at:
                self._add_text(html[at:start])
            at = hit.end()
            closing, name, attrs = hit.groups()
            if name is None:
                continue
            tag = name.lower()
            if closing:
                if open_elements[-1].tag == tag:
                    open_elements.pop()
                else:
                    self._end_tag(tag)
            elif self._start_tag(tag, attrs) and tag in NO_TAGS_INSIDE:
                end = re.compile(rf"</{tag}(?=[\t\n\f\r />])", re.I).search(html, at)
                stop = end.start() if end else len(html)
                inside = html[at:stop]
                open_elements[-1].children.append(inside if tag in RAW_TEXT else unescape(inside))
                at = stop
        if at < len(html):
            self._add_text(html[at:])

    def _start_tag(self, tag: str, attrs: str) -> bool:
        if tag in HOSTS:
            if self.open[-1].tag != USUAL_HOST[tag]:
                if not self._nearest(("table",), ()):
                    return False
                self._make_room(tag)
        elif tag == "table" and self.open[-1].tag in BETWEEN_CELLS:
            self._end(("table",), ())
        elif tag == "a":
            self._end(("a",), SCOPE_END)
        self._push(tag, attrs)
        return True

    def _end_tag(self, tag: str) -> None:
        if tag == "table":
            self._end((tag,), ())
        elif tag in HOSTS:
            self._end((tag,), ("table",))
        elif tag not in ("html", "body"):
            self._end((tag,), SCOPE_END)

    def _add_text(self, data: str) -> None:
        if "&" in data:
            data = unescape(data)
        here = self.open[-1]
        if here.tag in BETWEEN_CELLS and SPACES.sub("", data):
            self._put_before_table(data)
        else:
            here.children.append(data)

    def _nearest(self, tags: tuple, stop: tuple) -> int:
        """Stack index of the innermost open element with one of the tags, or 0."""
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in tags:
                return i
            if tag in stop:
                break
        return 0

    def _end(self, tags: tuple, stop: tuple) -> None:
        at = self._nearest(tags, stop)
        if at:
            del self.open[at:]

    def _make_room(self, tag: str) -> None:
        del self.open[self._nearest(HOSTS[tag], ()) + 1 :]
        if tag in ("tr", *CELLS) and self.open[-1].tag == "table":
            self._push("tbody")
        if tag in CELLS and self.open[-1].tag in SECTIONS:
            self._push("tr")

    def _push(self, tag: str, attrs: str = "") -> None:
        above = self.open[-1]
        if above.tag in BETWEEN_CELLS and tag not in STAY_IN_TABLE:
            element = Element(tag, None, attrs)
            self._put_before_table(element)
        else:
            element = Element(tag, above, attrs)
            above.children.append(element)
        if tag not in VOID:
            self.open.append(element)

    def _put_before_table(self, node: Element | str) -> None:
        table = self.open[self._nearest(("table",), ())]
        home = table.parent
        home.children.insert(home.children.index(table), node)
        if isinstance(node, Element):
            node.parent = home

    def _number(self) -> None:
        """Give every element its place, the slice of texts inside it and its table context."""
        texts, found = self.texts, self.found
        place, bodies = 0, 0
        tables: list[Element] = []
        stack: list = [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                texts.append(node)
                continue
            if isinstance(node, tuple):
                (element,) = node
                element.words = (element.words, len(texts))
                element.end = place
                if element.tag == "tbody":
                    bodies -= 1
                elif element.tag == "table":
                    tables.pop()
                continue
            node.place = place
            place += 1
            node.words = len(texts)
            node.in_body = bodies > 0
            node.table = tables[-1] if tables else None
            tag = node.tag
            if tag in LISTED:
                found[LISTED[tag]].append(node)
            if tag == "tbody":
                bodies += 1
            elif tag == "table":
                tables.append(node)
            stack.append((node,))
            stack.extend(reversed(node.children))


def page_text(html: str) -> Iterator[tuple]:
    """One record: text of the whole page, entities decoded, whitespace collapsed."""
    yield (Page(html).whole_text(),)


def page_links(html: str) -> Iterator[tuple]:
    """Ordinal, text and target of every link."""
    page = Page(html)
    for i, anchor in enumerate(page.found["a"]):
        href = next((value for name, value in anchor.attributes() if name == "href"), "")
        yield i, page.text(anchor), href


def page_tables(html: str) -> Iterator[tuple]:
    """Ordinal, number of rows and text of every table."""
    page = Page(html)
    for i, table in enumerate(page.found["table"]):
        yield i, len(page.within(table, "tr")), page.text(table)


def page_table_rows(html: str, cell_html: int = 0, row_text: bool = False) -> Iterator[tuple]:
    """Rows of every table with their cells; a nested row appears under each enclosing table.

    A record is: table ordinal, ordinal among the table's body rows (NULL on head and foot
    rows), ordinal among all rows of the page, whether this table is the row's innermost,
    row text on request, cells. ``cell_html`` is how much markup to keep per cell.
    """
    page = Page(html)
    for table_idx, table in enumerate(page.found["table"]):
        body_rows = 0
        first = bisect_left(page.places["tr"], table.place)
        for page_row_idx, row in enumerate(page.within(table, "tr"), first):
            yield (
                table_idx,
                body_rows if row.in_body else None,
                page_row_idx,
                row.table is table,
                page.text(row) if row_text else None,
                [_cell(page, cell, cell_html) for cell in page.within(row, "cell")],
            )
            body_rows += row.in_body


def body_row_texts(html: str, table_idx: int) -> Iterator[tuple]:
    """Ordinal and non-empty cell texts of the body rows of one table."""
    page = Page(html)
    body_rows = 0
    for table in page.found["table"][table_idx : table_idx + 1]:
        for row in page.within(table, "tr"):
            if row.in_body:
                texts = [page.text(cell) for cell in page.within(row, "cell")]
                yield body_rows, [text for text in texts if text]
                body_rows += 1


def wide_body_rows(
    html: str, first_table: int, min_cells: int, wanted: tuple[int, ...], linked: int
) -> Iterator[tuple]:
    """Wanted cells of body rows with enough cells: table and row ordinal, the cells' texts, and
    texts of the first link, and of the first span in it, of the ``linked`` cell."""
    page = Page(html)
    for table_idx, table in enumerate(page.found["table"]):
        if table_idx < first_table:
            continue
        body_rows = -1
        for row in page.within(table, "tr"):
            body_rows += row.in_body
            cells = page.within(row, "cell") if row.in_body else ()
            if len(cells) >= min_cells:
                _, anchor, span, _ = _cell(page, cells[linked], 0)
                yield table_idx, body_rows, [page.text(cells[i]) for i in wanted], anchor, span


def rows_with_word(html: str, word: str, cell_html: int) -> Iterator[tuple]:
    """Page rows whose text holds the word: ordinal, row text, text and markup of each cell."""
    page = Page(html)
    for page_row_idx, row in enumerate(page.found["tr"]):
        text = page.text(row) if row.table is not None else ""
        if word in text and row.table is not None:
            cells = page.within(row, "cell")
            yield page_row_idx, text, [(page.text(c), c.inner_html(cell_html)) for c in cells]


def _cell(page: Page, cell: Element, cell_html: int) -> tuple:
    """Cell text, text of its first link, text of the first span in that link, markup."""
    anchors = page.within(cell, "a") if page.found["a"] else ()
    spans = page.within(anchors[0], "span") if anchors else ()
    return (
        page.text(cell),
        page.text(anchors[0]) if anchors else None,
        page.text(spans[0]) if spans else None,
        cell.inner_html(cell_html) if cell_html else None,
    )
