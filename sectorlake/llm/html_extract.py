"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text at block-level tags; scripts, forms and what is hidden are no text.  A classifier gives each
block a score (its words, punctuation, links and place in the page) that becomes a terminal capacity; blocks that follow each
other, and blocks under one parent, are joined by smoothness edges that weaken with their distance in the tree.  The minimum
cut keeps the content side.  No score is out of the edges' reach: short lines count as boilerplate alone and stay by their
neighbours.  One pass over the rows, no shuffle; a task holds one Arrow batch.

Defined cases: a null or empty page has an empty text; a page without tags is one block; an unclosed comment or
script ends the page; ties of the cut go to boilerplate; a very long page is one row, its work linear in its length but for the
augmenting paths; repeated rows give repeated results; an empty table gives an empty result; columns other than those named
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sectorlake.llm.maxflow import min_cut_labels

#: Attributes up to the end of a tag: a quote opens a value only after an equals sign.
_ATTRS = r"(?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*))*+"
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    rf"|<(?P<raw>script|style|noscript|template|svg|annotation|annotation-xml|iframe|object|canvas|audio|video|select|datalist|textarea|button|title)(?=[\s/>])(?P<rawattr>{_ATTRS})>(?:.*?</(?P=raw)\s*>|.*)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>{_ATTRS})>"
    r"|<(?:[!?/]|[a-zA-Z])[^>]*(?:>|$)",
    re.S | re.I,
)
#: Tags inside a line of text, those of formulas included; any other tag but br ends the block.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math semantics mi mo mn ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle mpadded mphantom menclose merror".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag that closes an open tag of these names, if no name of the second group lies between.
_CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_P_ENDS = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SCOPE = frozenset("article aside body button div footer form header html li main nav section table td th".split())
_BOILER_TAGS = frozenset("nav footer aside menu dialog".split())
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary dialog alert alertdialog menu menubar toolbar".split())
_MAIN_TAGS = frozenset(["article", "main"])
_NAMES = re.compile(
    r"(?<![a-z])(?:ads?|adverts?|advertisement|advertising|adslot|adsense|adbox|sponsor(?:ed|s)?|promo(?:tion|tions|ted)?|banner|nav|navbar|navigation|menus?|submenu|topbar|header|masthead|footer|"
    r"side-?bar|sidenav|aside|widgets?|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|subscription|signup|shar(?:e|ing)|social|related|recommend(?:ed|ations?)?|"
    r"breadcrumbs?|pager|pagination|comments?|commentlist|replies|responses|disqus|respond|login|search|toolbar|copyright|disclaimer|legal|skip-?link|tags|tagcloud|byline-ads?)(?![a-z])"
)
_ARTICLE_NAMES = re.compile(r"(?<![a-z-])(?:comments?|reply|replies|ads?|promo|sponsored|related)(?![a-z-])")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_SENTENCE = re.compile(r"[.!?,;:…。！？、](?=\s|$)")

SHORT = 100  # what a block owes before its words count: about 14 words, or 8 with a full stop
PLACED = 600  # what a place such as a navigation or a footer takes
NAMED = 500  # what a boilerplate name, or a header outside the main element, takes: about a long block's words
MAIN = 90  # what the main element adds to its blocks and takes from others, if it holds all of the page's text
ADJACENT, SIBLING = 200, 80  # smoothness of blocks that follow each other, and of blocks under one parent


class _Node:
    __slots__ = ("tag", "parent", "depth", "boiler", "main", "soft", "has_main", "hidden")

    def __init__(self, tag: str, parent: "_Node | None", attrs: str):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.boiler = tag in _BOILER_TAGS
        self.main = tag in _MAIN_TAGS
        self.soft = False  # boilerplate by a name only
        self.has_main = False
        self.hidden = tag == "form" or (parent is not None and parent.hidden)
        if len(attrs) > 5:
            for name, value in _ATTR.findall(attrs):
                name, value = name.lower(), value.strip("\"'").lower()
                if name in ("id", "class"):
                    if self.main:
                        self.boiler |= bool(_ARTICLE_NAMES.search(value))
                    elif tag not in ("html", "body") and _NAMES.search(value.replace("_", "-")):
                        self.soft = True
                elif name == "role":
                    self.hidden |= value in ("form", "search")
                    self.boiler |= value in _BOILER_ROLES
                    self.main |= value in ("main", "article")
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                    self.hidden = True


class Block:
    __slots__ = ("text", "node", "links")

    def __init__(self, text: str, node: _Node, links: int):
        self.text, self.node, self.links = text, node, links


def blocks(html: str) -> list[Block]:
    """The blocks of text of a page, in page order."""
    out: list[Block] = []
    node = root = _Node("", None, "")
    parts: list[str] = []
    owner = root
    links = link_depth = 0

    def close() -> None:
        nonlocal links
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text and not owner.hidden:
                out.append(Block(text, owner, links))
        links = 0

    def pop_to(names: frozenset, stop: frozenset) -> None:
        nonlocal node
        at = node
        while at is not root and at.tag not in names:
            if at.tag in stop:
                return
            at = at.parent
        if at is not root:
            node = at.parent

    last, head = 0, False
    for m in _TOKEN.finditer(html):
        if m.start() > last and not head:
            piece = html[last : m.start()]
            if not parts:
                owner = node
                while owner.tag in _INLINE:
                    owner = owner.parent
            parts.append(piece)
            if link_depth:
                links += len(piece.strip())
        last = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"] and m["raw"].lower() not in ("script", "style"):
                close()
            continue
        tag = tag.lower()
        if tag == "head":
            head = not m["end"]
            continue
        if tag == "body":
            head = False
        if tag == "br":
            if parts:
                parts.append(" ")
            continue
        if tag in _INLINE:
            if tag == "a":
                link_depth = 0 if m["end"] else 1
            continue
        close()
        if m["end"]:
            at = node
            while at is not root and at.tag != tag:
                at = at.parent
            if at is not root:
                node, link_depth = at.parent, 0
        elif tag not in _VOID:
            if tag in _P_ENDS:
                pop_to(frozenset(["p"]), _SCOPE)
            if tag in _CLOSES:
                pop_to(*_CLOSES[tag])
            node = _Node(tag, node, m["attr"])
            if node.main and not node.boiler:
                at = node.parent
                while at is not None and not at.has_main:
                    at.has_main = True
                    at = at.parent
    if not head and last < len(html):
        if not parts:
            owner = node
        parts.append(html[last:])
    close()
    return out


def place(block: Block) -> tuple[bool, bool, bool]:
    """Whether the block's place is one of boilerplate, whether it has a boilerplate name, and whether it is in a main element."""
    at, main, header, soft = block.node, False, False, False
    while at is not None:
        if at.boiler:
            return True, False, False
        soft |= at.soft and not at.has_main
        header |= at.tag == "header"
        main |= at.main
        at = at.parent
    return False, soft or (header and not main), main


def scores(found: list[Block]) -> list[int]:
    """The classifier: positive for content.  A main element counts by its share of the text that may be content."""
    places = [place(b) for b in found]
    size = [0 if placed or named else len(b.text) for b, (placed, named, _) in zip(found, places, strict=True)]
    weight = MAIN * sum(n for n, (*_, main) in zip(size, places, strict=True) if main) // max(1, sum(size))
    return [_words(b) - PLACED * placed - NAMED * named + (weight if main else -weight) for b, (placed, named, main) in zip(found, places, strict=True)]


def _words(block: Block) -> int:
    words = block.text.count(" ") + 1
    value = min(words, 60) * 6 - SHORT
    value += 40 * sum(1 for _ in islice(_SENTENCE.finditer(block.text), 3))
    value -= 300 * min(block.links, len(block.text)) // max(1, len(block.text))
    return value + 60 * (block.node.tag in ("h1", "h2", "h3"))


def smoothness(found: list[Block]) -> dict[tuple[int, int], int]:
    """Capacities between blocks that follow each other and between neighbours under one parent."""
    edges: dict[tuple[int, int], int] = {}
    before: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            edges[i - 1, i] = ADJACENT // (1 + _distance(found[i - 1].node, b.node))
        key = id(b.node.parent)
        if (j := before.get(key)) is not None:
            edges[j, i] = edges.get((j, i), 0) + SIBLING
        before[key] = i
    return edges


def _distance(a: _Node, b: _Node) -> int:
    """Steps between two nodes in the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def main_text(html: str | None) -> str:
    """The content blocks of a page, joined by one space."""
    found = blocks(html or "")
    if not found:
        return ""
    keep = min_cut_labels(scores(found), smoothness(found))
    if not any(keep):  # a page of scraps alone: all that neither place nor name speaks against
        keep = [not (placed or named) for placed, named, _ in map(place, found)]
    return " ".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) of every page."""
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string")).mapInArrow(run, f"{kinds}, text string, n_chars bigint")
