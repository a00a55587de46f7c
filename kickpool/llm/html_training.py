"""Training pages for the main-text model, composed from the text of real pages.

A real page tells its article and its other regions by element names. Their texts are put into
pages of many layouts in which every region is known: with and without telling element names or
attributes, with closed and unclosed paragraphs, with boilerplate inside the article.
"""

from __future__ import annotations

import html
import random
import re

from kickpool.llm.html_tree import KIND_OF, TAG_KINDS, TOKEN_KINDS, Block, joined, read

NEUTRAL = "wrapper row col-8 container inner box grid-4 c12 block unit module cell x7 layout".split()
DROP_TAGS = {list(TAG_KINDS).index(k) for k in ("nav", "footer", "aside", "form")}
MAIN_TAG = list(TAG_KINDS).index("main")
CONTENT = list(TOKEN_KINDS).index("content")
OPENING = re.compile(r"<(\w+)")
BYLINE = list(TOKEN_KINDS).index("byline")


def teach(blocks: list[Block]) -> None:
    """Answers of a real page: what its element names and attributes say, else none."""
    for block in blocks:
        up = blocks[block.parent].truth if block.parent >= 0 else None
        kind = KIND_OF.get(block.tag)
        telling = [t for t in block.tokens if t not in (CONTENT, BYLINE)]
        if up == 0 or kind in DROP_TAGS or (telling and up is None):
            block.truth = 0
        elif up == 1 or kind == MAIN_TAG:
            block.truth = 1


def parts_of(page: str) -> tuple[list[str], list[str]] | None:
    """Article blocks and other blocks of a real page, as texts; none if it tells no article."""
    blocks, pieces = read(page)
    teach(blocks)
    texts = [
        [joined(pieces, [n == at for n in range(len(blocks))]) for at, b in enumerate(blocks) if b.truth == truth]
        for truth in (1, 0)
    ]
    good, other = ([t for t in some if t] for some in texts)
    return (good, other) if good and other else None


class Composer:
    def __init__(self, seed: int, pages: list[tuple[list[str], list[str]]]) -> None:
        self.chance = random.Random(seed)
        self.others = [t for _, other in pages for t in other]
        self.prose = [t for good, _ in pages for t in good]

    def maybe(self, share: float) -> bool:
        return self.chance.random() < share

    def names(self, kind: str | None, telling: float = 0.85) -> str:
        c = self.chance
        words = [c.choice(NEUTRAL)] if self.maybe(0.5) else []
        if kind and self.maybe(telling):
            words.append(c.choice(TOKEN_KINDS[kind].split()))
            if self.maybe(0.4):
                words.append(c.choice(NEUTRAL))
            c.shuffle(words)
        if not words:
            return ""
        return f' {c.choice(("class", "class", "id"))}="{c.choice(("-", " ", "_")).join(words)}"'

    def element(self, tag: str, inner: str, kind: str | None = None, truth: int | None = None, telling: float = 0.85) -> str:
        told = "" if truth is None else f' truth="{truth}"'
        return f"<{tag}{self.names(kind, telling)}{told}>{inner}</{tag}>"

    def line(self, words: int = 12) -> str:
        text = self.chance.choice(self.others if self.maybe(0.5) else self.prose).split()
        at = self.chance.randrange(max(1, len(text) - words))
        return html.escape(" ".join(text[at : at + self.chance.randint(1, words)]), quote=False)

    def passage(self) -> str:
        return html.escape(" ".join(self.chance.choice(self.prose).split()[: self.chance.randint(5, 120)]), quote=False)

    def links(self, words: int = 3) -> str:
        c = self.chance
        made = [f'<a href="/{i}">{self.line(words)}</a>' for i in range(c.randint(2, 9))]
        if self.maybe(0.7):
            return "<ul>" + "".join(f"<li>{a}</li>" for a in made) + "</ul>"
        return c.choice((" ", " | ", " &middot; ")).join(made)

    def region(self, kind: str) -> str:
        c = self.chance
        if kind == "nav":
            tag = c.choice(("nav", "nav", "div", "section", "ul"))
            inner = self.links() if tag != "ul" else "".join(f"<li><a href='#'>{self.line(2)}</a></li>" for _ in range(5))
            return self.element(tag, inner, "nav", 0, 0.4 if tag == "nav" else 1)
        if kind == "header":
            tag = c.choice(("header", "header", "div"))
            name = c.choice(("h1", "div", "p", "h2"))
            inner = f"<{name}>{self.line(5)}</{name}>" + (f"<p>{self.line()}</p>" if self.maybe(0.5) else "")
            if self.maybe(0.4):
                inner += self.region("nav")
            return self.element(tag, inner, "header", 0, 0.5 if tag == "header" else 1)
        if kind == "footer":
            tag = c.choice(("footer", "footer", "div", "section"))
            inner = f"&copy; {self.line()}" if self.maybe(0.5) else f"<p>&copy; 2024 {self.line()}</p>"
            inner += self.links() if self.maybe(0.4) else ""
            return self.element(tag, inner, "footer", 0, 0.5 if tag == "footer" else 1)
        if kind == "side":
            tag = c.choice(("aside", "div", "section"))
            level = c.randint(2, 4)
            inner = f"<h{level}>{self.line(4)}</h{level}>" if self.maybe(0.7) else ""
            inner += "".join(c.choice((self.links(6), f"<p>{self.line(30)}</p>", f"<div>{self.passage()}</div>")) for _ in range(c.randint(1, 4)))
            return self.element(tag, inner, "side", 0, 0.4 if tag == "aside" else 1)
        if kind == "notice":
            tag = c.choice(("div", "section", "aside", "p"))
            inner = self.line(30) if tag == "p" or self.maybe(0.4) else f"<p>{self.line(30)}</p><button>{self.line(2)}</button>"
            return self.element(tag, inner, "notice", 0, 1)
        if kind == "ad":
            tag = c.choice(("div", "div", "aside", "section", "p"))
            return self.element(tag, self.line(25), "ad", 0, 1)
        if kind == "form":
            inner = "".join(f"<label>{self.line(3)}</label><input name='a'>" for _ in range(c.randint(1, 3)))
            inner += f"<p>{self.line()}</p>" * self.maybe(0.5) + f"<button type='submit'>{self.line(2)}</button>"
            return self.element("form", inner, "form", 0, 0.5)
        if kind == "share":
            return self.element(c.choice(("div", "ul", "p")), self.links(2), "share", 0, 1)
        tag = c.choice(("div", "article", "li", "p"))
        # A list of comments may have no telling name at all; then its place and its items tell.
        telling = 0.0 if tag == "li" and self.maybe(0.4) else 1
        inner = f"<h3>{self.line(3)}</h3>" * self.maybe(0.6) if telling else ""
        for _ in range(c.randint(1, 6) if telling else c.randint(2, 40)):
            told = self.passage() if tag == "p" or self.maybe(0.3) else f"<p>{self.line(4)}</p><p>{self.passage()}</p>"
            inner += self.element(tag, told, "comment", 0, 0.8 * telling)
        return self.element(c.choice(("div", "section", "ol" if tag == "li" else "aside")) if telling else "ol", inner, "comment", 0, telling)

    def article(self, texts: list[str]) -> str:
        c = self.chance
        tag = c.choice(("article", "article", "main", "div", "div", "section", ""))
        if self.maybe(0.1):  # a text of a few words
            texts = [" ".join(texts[0].split()[: c.randint(1, 8)])]
        closed, body = self.maybe(0.7), c.choice(("p", "p", "p", "div"))
        made = []
        for number, text in enumerate(texts):
            words = html.escape(text, quote=False)
            if self.maybe(0.15):
                words = words.replace(" ", " <b>", 1).replace(". ", "</b>. ", 1)
            if self.maybe(0.15):
                words = words.replace(" ", " <a href='/x'>", 1).replace(", ", "</a>, ", 1)
            if number == 0 and self.maybe(0.8):
                told = f"<h1>{html.escape(text[:60], quote=False)}</h1>"
                made.append(f"<header>{told}</header>" if self.maybe(0.15) else told)
            kind = c.random()
            if kind < 0.06:
                made.append(f"<ul><li>{words}</li><li>{self.line(20)}</li></ul>")
            elif kind < 0.1:
                made.append(f"<blockquote><p>{words}</p></blockquote>")
            elif kind < 0.13:
                made.append(f"<h2>{self.line(6)}</h2><p>{words}</p>")
            elif kind < 0.16:
                made.append(f"<figure><img src='a'><figcaption>{self.line(15)}</figcaption></figure><p>{words}</p>")
            elif kind < 0.18:
                made.append(f"<table><tr><td>{self.line(6)}</td><td>{words}</td></tr></table>")
            else:
                made.append(f"<{body}>{words}" + (f"</{body}>" if closed or body == "div" else ""))
            if self.maybe(0.05):
                made.append(self.region(c.choice(("ad", "share", "notice", "side", "form"))))
        inner = ("\n" if self.maybe(0.5) else "").join(made)
        if not tag:  # straight in the body
            return "".join(m if " truth=" in m[: m.index(">")] else OPENING.sub(r'<\1 truth="1"', m, 1) for m in made)
        if self.maybe(0.2):
            inner = self.element("div", inner, None)
        return self.element(tag, inner, "content", 1, 0.3 if tag in ("article", "main") else 0.75)

    def page(self, texts: list[str]) -> str:
        c = self.chance
        share = {"header": 0.5, "nav": 0.7, "side": 0.5, "notice": 0.35, "ad": 0.5, "form": 0.25, "comment": 0.4, "share": 0.2}
        chosen = [k for k, s in share.items() if self.maybe(s)]
        c.shuffle(chosen)
        before = [k for k in ("notice", "header", "nav") if k in chosen]
        around = [k for k in chosen if k in ("side", "ad", "share")]
        cut = c.randint(0, len(around))
        after = [k for k in chosen if k in ("form", "comment")]
        made = [self.region(k) for k in before + around[:cut]]
        made.append(self.article(texts))
        made += [self.region(k) for k in around[cut:] + after]
        if self.maybe(0.85):
            made.append(self.region("footer"))
        inner = "".join(made)
        if self.maybe(0.4):
            inner = self.element("div", inner, None)
        return f"<html><head><title>{self.line(5)}</title></head><body>{inner}</body></html>"
