"""Block tree of a web page: tolerant reading, and the features of each block.

Comments, scripts, styles and the head are left out while reading. Inline elements belong to the
block they stand in. A missing end tag is supplied where a block begins or the enclosing one ends.
A head without end tag ends at the first tag or text that may not stand in it, a title at the next
tag; a script or style without end tag reaches to the end of the page, as in browsers; of other
unread elements without end tag only the tag is left out.
"""

from __future__ import annotations

import html
import math
import re

# Fixed values of the HTML standard, as far as they matter for the division into blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style template noscript iframe object svg math head title canvas audio video".split())
UNREAD_TO_END = frozenset(("script", "style"))
UNREAD_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE) for name in UNREAD}
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr img br".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details dd div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr li main menu nav ol p pre section table ul".split()
)
CLOSED_BY_SAME = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",),
}
SCOPE = frozenset("ul ol dl table body article section div main aside nav form".split())
LISTS = frozenset(("ul", "ol", "dl", "table", "select"))

# Quotes count after an equals sign only. A tag that the page's end cuts off is no text.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/[^a-zA-Z])[^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)"
    r"(?P<attrs>(?:=[\t\n\f\r ]*+(?:\"[^\"]*+\"|'[^']*+'|[^\t\n\f\r >]*+)|[^>=]++)*+)(?:>|\Z)",
    re.DOTALL,
)
ATTR = re.compile(
    r"(class|id|role|itemprop|itemtype|aria-label|aria-hidden|style|data-[a-z-]+|hidden)"
    r"(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?",
    re.IGNORECASE,
)
TRUTH = re.compile(r'truth="(\d)"')
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

TAG_KINDS = {
    "heading": "h1 h2 h3 h4 h5 h6",
    "paragraph": "p",
    "list": "ul ol dl menu",
    "item": "li dt dd",
    "table": "table tbody thead tr td th",
    "box": "div section center",
    "main": "article main",
    "nav": "nav",
    "header": "header",
    "footer": "footer address",
    "aside": "aside dialog details",
    "form": "form fieldset select textarea button input option legend",
    "figure": "figure figcaption",
    "quote": "blockquote pre",
    "body": "body html",
}
KIND_OF = {tag: i for i, tags in enumerate(TAG_KINDS.values()) for tag in tags.split()}
# Attribute tokens by what they commonly name.
TOKEN_KINDS = {
    "content": "content article main post entry story body text prose blog page",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc sitemap links",
    "header": "header head masthead topbar logo branding hero site",
    "footer": "footer foot copyright colophon legal bottom imprint",
    "side": "sidebar side aside widget related recommended recommendations rail trending popular archive",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe "
    "subscription signup paywall disclaimer warning toast banner announcement privacy",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion dfp adsense "
    "banner affiliate",
    "comment": "comment comments reply replies respond disqus discussion commentlist reader feedback thread",
    "share": "share sharing social follow tweet facebook",
    "byline": "byline author meta date tags tag category posted timestamp",
    "form": "form search login register contact input button",
    "hidden": "hidden none invisible sr offscreen",
}
TOKEN_KIND_OF: dict[str, list[int]] = {}
for _i, _words in enumerate(TOKEN_KINDS.values()):
    for _word in _words.split():
        TOKEN_KIND_OF.setdefault(_word, []).append(_i)
KINDS, TOKENS = len(TAG_KINDS), len(TOKEN_KINDS)
FEATURES = 18 + KINDS + 2 * TOKENS + KINDS


class Block:
    __slots__ = (
        "tag", "parent", "depth", "tokens", "place", "alike", "chars", "link_chars", "marks", "tags", "words", "children",
        "sum_chars", "sum_links", "sum_marks", "sum_tags", "sum_blocks", "begin", "truth",
    )

    def __init__(self, tag: str, parent: int, depth: int, tokens: tuple[int, ...], begin: int) -> None:
        self.tag, self.parent, self.depth, self.tokens, self.begin = tag, parent, depth, tokens, begin
        self.chars = self.link_chars = self.marks = self.tags = self.words = 0
        self.children: list[int] = []
        self.place = 0  # among the parent's children
        self.alike: dict[str, int] = {}  # how many children have a tag
        self.truth = None


class Open:
    """Open blocks, with the places of each tag, so that none is searched for."""

    def __init__(self) -> None:
        self.blocks, self.tags = [0], ["body"]
        self.places: dict[str, list[int]] = {"body": [0]}
        self.scopes, self.lists = [0], []

    def last(self, *tags: str) -> int:
        """Place of the innermost block of the tags above the body, or 0."""
        return max(self.places[tag][-1] if self.places.get(tag) else 0 for tag in tags)

    def put(self, tag: str, block: int) -> None:
        place = len(self.blocks)
        self.blocks.append(block)
        self.tags.append(tag)
        self.places.setdefault(tag, []).append(place)
        if tag in SCOPE:
            self.scopes.append(place)
        if tag in LISTS:
            self.lists.append(place)

    def close(self, place: int) -> None:
        """Close the block at a place and all inside it."""
        while len(self.blocks) > place:
            tag = self.tags.pop()
            self.blocks.pop()
            self.places[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()
            if tag in LISTS:
                self.lists.pop()


def token_kinds(attrs: str) -> tuple[int, ...]:
    """Kinds of what the attributes of a tag name."""
    found = set()
    for name, *values in ATTR.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (
            name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE)
        ):
            found.add(TOKENS - 1)
        elif name != "style":
            for part in NAME_PARTS.findall(value):
                found.update(TOKEN_KIND_OF.get(part.lower(), ()))
    return tuple(found)


def read(page: str, truths: bool = False) -> tuple[list[Block], list[tuple[int, str]]]:
    """Blocks, parents first, and ``(block, text)`` pieces in page order.

    ``truths``: blocks take over the answer that training pages carry in an attribute.
    """
    blocks = [Block("body", -1, 0, (), 0)]
    pieces: list[tuple[int, str]] = []
    open_ = Open()
    stack = open_.blocks
    links = 0  # whether a link is open
    seen, at = 0, 0
    in_head = False
    unclosed: set[str] = set()  # unread elements without an end tag in the rest of the page

    def text(raw: str) -> None:
        nonlocal seen
        if raw:
            told = html.unescape(raw) if "&" in raw else raw
            pieces.append((stack[-1], told))
            words = told.split()
            if words:
                block = blocks[stack[-1]]
                n = sum(map(len, words)) + len(words)
                block.chars += n
                block.words += len(words)
                block.marks += told.count(".") + told.count(",")
                if links:
                    block.link_chars += n
                seen += n

    while found := TOKEN.search(page, at):
        begin = found.start()
        if begin > at:
            in_head = in_head and page[at:begin].isspace()
            if not in_head:
                text(page[at:begin])
        name = found["name"]
        at = found.end()
        if name is None:
            continue
        name = name.lower()
        if in_head:
            if found["end"]:
                in_head = name not in ("head", "body", "html", "br")
                continue
            in_head = name in HEAD
            if in_head and name not in UNREAD:
                continue
        if found["end"]:
            if name == "a":
                links = 0
            elif name == "p" or name not in INLINE:
                place = open_.last(name)
                if place and not (name in ("p", "li", "dd", "dt") and open_.scopes[-1] > place):
                    open_.close(place)
                    links = 0
            continue
        if name in UNREAD:
            if name == "head":
                in_head = True
            elif not found["attrs"].endswith("/"):
                end = None if name in unclosed else UNREAD_END[name].search(page, at)
                if end:
                    at = end.end()
                    continue
                unclosed.add(name)
                if name in UNREAD_TO_END:
                    at = len(page)
                elif name == "title":
                    tag = page.find("<", at)
                    at = tag if tag >= 0 else len(page)
            continue
        if name in INLINE or name in VOID:
            if name == "a":
                links = 1
            elif name == "br" or name == "hr":
                pieces.append((stack[-1], " "))
            blocks[stack[-1]].tags += 1
            continue
        if name in ("html", "body"):
            continue
        if name in CLOSES_P and (place := open_.last("p")) > open_.scopes[-1]:
            open_.close(place)
        same = CLOSED_BY_SAME.get(name)
        if same and (place := open_.last(*same)) > (open_.lists[-1] if open_.lists else 0):
            open_.close(place)
        links = 0
        parent = stack[-1]
        blocks.append(Block(name, parent, blocks[parent].depth + 1, token_kinds(found["attrs"]), seen))
        if truths:
            told = TRUTH.search(found["attrs"])
            blocks[-1].truth = int(told[1]) if told else blocks[parent].truth
        blocks[-1].place = len(blocks[parent].children)
        blocks[parent].alike[name] = blocks[parent].alike.get(name, 0) + 1
        blocks[parent].children.append(len(blocks) - 1)
        open_.put(name, len(blocks) - 1)
    if at < len(page) and not (in_head and page[at:].isspace()):
        text(page[at:])
    for block in blocks:
        block.sum_chars, block.sum_links, block.sum_marks = block.chars, block.link_chars, block.marks
        block.sum_tags, block.sum_blocks = block.tags, 1
    for block in reversed(blocks[1:]):
        up = blocks[block.parent]
        up.sum_chars += block.sum_chars
        up.sum_links += block.sum_links
        up.sum_marks += block.sum_marks
        up.sum_tags += block.sum_tags + 1
        up.sum_blocks += block.sum_blocks
    return blocks, pieces


def features(blocks: list[Block]) -> list[list[float]]:
    """Feature row of each block: densities of its subtree, depth, siblings, tags, attribute tokens."""
    total = max(blocks[0].sum_chars, 1)
    deepest = max(b.depth for b in blocks) or 1
    above: list[tuple[frozenset, frozenset]] = []
    rows = []
    for b in blocks:
        up = blocks[b.parent] if b.parent >= 0 else b
        tags_above, tokens_above = above[b.parent] if b.parent >= 0 else (frozenset(), frozenset())
        kind = KIND_OF.get(b.tag)
        above.append((tags_above | {kind}, tokens_above | set(b.tokens)))
        siblings = len(up.children) if b.parent >= 0 else 1
        alike = up.alike[b.tag] if b.parent >= 0 else 1
        around = max(up.sum_chars, 1)
        row = [0.0] * FEATURES
        row[:18] = [
            b.depth,
            b.depth / deepest,
            math.log1p(b.sum_chars),
            math.log1p(b.chars),
            b.sum_links / max(b.sum_chars, 1),
            b.link_chars / max(b.chars, 1),
            b.sum_chars / (b.sum_tags + 1),
            b.sum_chars / total,
            b.begin / total,
            (b.begin + b.sum_chars) / total,
            b.sum_chars / around,
            siblings,
            b.place / siblings,
            alike,
            len(b.children),
            100 * b.sum_marks / max(b.sum_chars, 1),
            b.sum_chars / b.sum_blocks,
            up.sum_links / around,
        ]
        if kind is not None:
            row[18 + kind] = 1.0
        for token in b.tokens:
            row[18 + KINDS + token] = 1.0
        for token in tokens_above:
            row[18 + KINDS + TOKENS + token] = 1.0
        for tag in tags_above:
            if tag is not None:
                row[18 + KINDS + 2 * TOKENS + tag] = 1.0
        rows.append(row)
    return rows


def joined(pieces: list[tuple[int, str]], keep: list[bool]) -> str:
    """Text of the kept blocks: blocks apart by a blank, white space runs as one blank."""
    out, last = [], None
    for block, text in pieces:
        if keep[block]:
            if block != last:
                out.append(" ")
            out.append(text)
            last = block
        else:
            last = None
    return " ".join("".join(out).split())
