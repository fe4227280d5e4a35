"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import small_batches

#: Elements without content, elements whose content is raw text, and elements that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold no text of a page; elements, roles and words of class or id that seldom are an article's.
NOT_TEXT = RAW | frozenset("head noscript template svg button select option input label dialog object canvas audio video map".split())
NOT_ARTICLE = frozenset("nav footer header aside form fieldset menu".split())
NOT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NOT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert menu nav navbar navigation breadcrumb breadcrumbs sidebar aside footer header masthead share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay widget pagination pager toolbar toc skip".split())
#: Words of class or id of what readers wrote.
READERS = frozenset("comment comments disqus reply replies respond".split())
#: Elements that a start tag closes if one of them is open, up to the element that bounds the search.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)), "option": (("option",), ("select",)), "body": (("head",), ()),
}
#: Fixed value: what bounds an open paragraph, and the blocks that don't close one.
_P = (("p",), tuple("article aside blockquote body div footer form header li main nav section table td th".split()))
_KEEPS_P = frozenset("dd dt li td th tr tbody thead tfoot option body html head br summary figcaption legend".split())
#: Fixed value: elements that can hold an article, as against a paragraph or a heading of one.
HOLDERS = frozenset("#root html body main article section div center td table blockquote dd form fieldset".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_QUOTE = re.compile("[\"']")


@dataclass(eq=False, slots=True)
class Node:
    tag: str
    parent: Node | None
    barred: int  # 0: not by itself, 1: seldom an article's, 2: what readers wrote, 3: never text
    skip: bool = False
    children: list = field(default_factory=list)
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    density: float = 0.0
    total: float = 0.0
    top: Node | None = None  # of the largest total among itself and the holders below


def _barred(tag: str, attributes: str) -> int:
    if tag in NOT_TEXT:
        return 3
    barred = int(tag in NOT_ARTICLE)
    if not attributes or tag in ("html", "body", "main"):
        return barred
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            words = set(_SPLIT.split(value.lower())) | set(_SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()))
            barred = max(barred, 2 * (not READERS.isdisjoint(words)), int(not NOT_WORDS.isdisjoint(words)))
        elif name == "role" and value.lower() in NOT_ROLES:
            barred = max(barred, 1)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 3
    return barred


def _length(text: str) -> int:
    return len("".join(text.split()))


def _settle(nodes: list[Node]) -> None:
    """Decide what is left out.

    What seems to bar an element tells of the page's layout instead, if the element holds more of the page's text than is
    left outside of all barred ones, and a heading, main or article besides; what readers wrote has to hold the page's h1. The
    header of an article is part of it.
    """
    free, inner, heads = {}, {}, {}  # characters without what is barred inside, with it but for readers' and never text; what it holds
    for node in reversed(nodes):
        free[id(node)] = inner[id(node)] = 0
        held = set()
        for c in node.children:
            if isinstance(c, str):
                n = _length(c)
                free[id(node)] += n
                inner[id(node)] += n
            else:
                free[id(node)] += 0 if c.barred else free[id(c)]
                inner[id(node)] += 0 if c.barred >= 2 else free[id(c)] if c.barred else inner[id(c)]
                held |= heads[id(c)] if c.barred < 3 else set()
        heads[id(node)] = held | ({node.tag} & (HEADINGS | {"main", "article"}))
    outside = free[id(nodes[0])]
    for node in nodes:
        up = node.parent
        bars = node.barred > 0
        if node.barred == 1 and node.tag == "header" and up is not None and any(n.tag == "article" for n in _upwards(up)):
            bars = not heads[id(node)] & HEADINGS
        elif node.barred in (1, 2) and node.tag != "article":
            need = {"h1"} if node.barred == 2 or node.tag in ("header", "footer", "nav", "aside") else HEADINGS | {"main", "article"}
            bars = not (heads[id(node)] & need and max(free[id(node)], inner[id(node)] // 2) > outside)
        node.skip = up is not None and up.skip or bars


def _upwards(node: Node | None):
    for _ in range(3):  # an article's header stands close below it
        if node is None:
            return
        yield node
        node = node.parent


class _Open:
    """The elements that are open, innermost last, and where those of each name and the blocks are among them."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.blocks = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        """Close the element at a place and all in it."""
        while len(self.nodes) > place:
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def end(self, tag: str) -> None:
        """An end tag of an inline element never closes a block around it; one without an open element does nothing."""
        place = self.last((tag,))
        if place and (tag in BLOCK or place > self.blocks[-1]):
            self.cut(place)

    def start(self, tag: str) -> None:
        """Close what a start tag closes by being there: also a drawing or formula, if the tag is of a block."""
        if tag in BLOCK and (drawn := self.last(("svg", "math"))):
            self.cut(drawn)
        closes, bounds = CLOSES.get(tag) or (_P if tag in BLOCK and tag not in _KEEPS_P else ((), ()))
        place = self.last(closes)
        if place > self.last(bounds):
            self.cut(place)


def _tag_end(page: str, at: int, lost: set[str]) -> int:
    """Where the tag that begins at a place ends, its quotes closed; at the first > if they aren't; -1 without any."""
    first = -1 if ">" in lost else page.find(">", at)
    if first < 0:
        lost.add(">")
        return -1
    end, here = first, at
    while True:
        quote = _QUOTE.search(page, here, end)
        if not quote:
            return end
        mark = quote[0]
        shut = -1 if mark in lost else page.find(mark, quote.end())
        if shut < 0:
            lost.add(mark)
            return first
        here = shut + 1
        if here > end:
            end = page.find(">", here)
            if end < 0:
                return first


def parse(page: str) -> list[Node]:
    """All elements in page order, the root first; a node's children are elements and strings, references decoded.

    One pass from < to <, each character looked at a few times at most: what the page lacks (an end tag of a raw
    element, a closing quote, any >) is looked for once.
    """
    root = Node("#root", None, 0)
    nodes, open_, at, lost = [root], _Open(root), 0, set()
    low = ""

    def text(a: int, b: int) -> None:
        if b > a:
            part = page[a:b]
            open_.nodes[-1].children.append(html.unescape(part) if "&" in part else part)

    begin = 0  # of the text that has not been taken
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = -1 if "-->" in lost else page.find("-->", at + 4)
            if end < 0:
                lost.add("-->")
                end = _tag_end(page, at, lost)
                end = end - 2 if end >= 0 else len(page)
            text(begin, at)
            begin = at = min(len(page), end + 3)
            continue
        closing = page.startswith("/", at + 1)
        name = _NAME.match(page, at + 1 + closing)
        if not name and not page.startswith(("<!", "<?", "</"), at):
            at += 1
            continue
        end = -1 if ">" in lost else _tag_end(page, name.end(), lost) if name else page.find(">", at)
        if end < 0:
            lost.add(">")
            at += 1
            continue
        text(begin, at)
        begin = at = end + 1
        if not name:
            continue
        tag = name[0].lower()
        if closing:
            open_.end(tag)
            continue
        open_.start(tag)
        attributes = page[name.end() : end]
        node = Node(tag, open_.nodes[-1], _barred(tag, attributes))
        open_.nodes[-1].children.append(node)
        nodes.append(node)
        if tag in RAW:
            low = low or page.lower()
            low = low if len(low) == len(page) else page
            shut = -1 if f"</{tag}" in lost else low.find(f"</{tag}", at)
            if shut < 0:  # it is taken to be empty
                lost.add(f"</{tag}")
                begin = at = page.find("<", at) if page.find("<", at) >= 0 else len(page)
                continue
            shut = page.find(">", shut)
            begin = at = shut + 1 if shut >= 0 else len(page)
        elif tag not in VOID and not (attributes.endswith("/") and open_.last(("svg", "math"))):
            open_.push(node)
    text(begin, len(page))
    _settle(nodes)
    return nodes


def measure(nodes: list[Node]) -> None:
    """Characters, tags, link characters and link tags of every node, its density, and its children's densities' sum.

    density = C/T * ln(C/LC * T/LT) / ln(e - 1 + ln(C*LC/(C-LC) + LCb*C/Cb + e)), b being the whole page; counts
    that divide are 1 at least, and e - 1 keeps the divisor from being 0 on a page without links. A run of text
    that stands beside elements counts as a child of its own.
    """
    for node in reversed(nodes):
        if node.skip:
            continue
        for child in node.children:
            if isinstance(child, str):
                node.chars += _length(child)
            elif not child.skip:
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.chars if child.tag == "a" else child.link_chars
                node.link_tags += child.link_tags + (child.tag == "a")
    root = nodes[0]
    share = root.link_chars / max(1, root.chars)

    def density(chars: int, tags: int, link_chars: int, link_tags: int) -> float:
        if not chars:
            return 0.0
        base = math.log(chars * link_chars / max(1, chars - link_chars) + share * chars + math.e)
        ratio = chars / max(1, link_chars) * max(1, tags) / max(1, link_tags)
        return chars / max(1, tags) * math.log(max(1.0, ratio)) / math.log(math.e - 1 + base)

    for node in reversed(nodes):
        if node.skip:
            continue
        linked = node.tag == "a"
        node.density = density(node.chars, node.tags, node.chars if linked else node.link_chars, node.link_tags + linked)
        for child in node.children:
            if isinstance(child, str):
                chars = _length(child)
                node.total += density(chars, 1, chars if linked else 0, int(linked))
            elif not child.skip:
                node.total += child.density
        node.top = node
        for child in node.children:
            if not isinstance(child, str) and child.top is not None and child.top.tag in HOLDERS and child.top.total > node.top.total:
                node.top = child.top


def _belongs(node: Node, best: Node) -> bool:
    """Whether a neighbour of the best subtree is part of the same article: a heading, a paragraph, list or the like, or
    an element of the same kind; but not one of links."""
    if node.skip or not node.chars or node.link_chars * 3 > node.chars:
        return False
    return node.tag in HEADINGS or node.tag not in HOLDERS or node.tag in ("table", "blockquote") or node.tag == best.tag and best.tag == "section"


def article_nodes(nodes: list[Node]) -> list[Node]:
    """The subtree of the largest sum, with its neighbours that belong to it; and, of other subtrees at least as dense as the
    thinnest node on its path to the body, the body included, the one of the largest sum in each. An article element
    around the largest sum stands for it."""
    live = [n for n in nodes if not n.skip and n.chars and n.tag in HOLDERS]
    if not live:
        return []
    best = max(live, key=lambda n: n.total)
    around = best
    while around is not None and around.tag != "article":
        around = around.parent
    best = around or best
    path, node = [], best
    while node is not None:
        path.append(node)
        node = node.parent
    threshold = min((n.density for n in path if n.tag not in ("html", "#root")), default=math.inf)
    chosen, on_path = [best], {id(n) for n in path}
    inside = {id(best)}
    if around is None and best.parent is not None and best.tag != "body":
        near = [c for c in best.parent.children if not isinstance(c, str) and c is not best and _belongs(c, best)]
        chosen += near
        inside |= {id(n) for n in near}
    for n in nodes[1:]:  # parents before children
        if id(n) in inside or id(n.parent) in inside:
            inside.add(id(n))
            continue
        if n.skip or not n.chars or id(n) in on_path or n.density < threshold or n.tag in ("html", "body") or n.link_chars * 2 > n.chars:
            continue
        held = n.tag not in HOLDERS and n.parent.tag in HOLDERS and id(n.parent) not in on_path
        at = n.parent if held else n  # what holds a paragraph stands for it
        inside |= {id(at), id(n)}
        chosen.append(at.top)
    order = {id(n): i for i, n in enumerate(nodes)}
    return sorted(chosen, key=lambda n: order[id(n)])


def text_of(node: Node) -> str:
    out: list[str] = []
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.skip:
            out.append(" ")
        elif x.tag in BLOCK:
            out.append(" ")
            stack.append(" ")
            stack.extend(reversed(x.children))
        else:
            stack.extend(reversed(x.children))
    return " ".join("".join(out).split())


def main_text(page: str | None) -> str:
    if not page:
        return ""
    nodes = parse(page)
    measure(nodes)
    return " ".join(t for t in map(text_of, article_nodes(nodes)) if t)


def html_text(page: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def of(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype=object)

    return of(page)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: its id, url, text (the article, blocks joined by a space), n_chars (code points).

    A null or empty page, or one without text, gives an empty text and 0. Malformed markup is read as browsers
    do in the main cases: unclosed paragraphs and list items, stray end tags, raw scripts and styles, broken
    attributes, blocks within drawings; a raw element or a comment that never ends is taken to be empty. Time grows with a
    page's length, however broken it is. Repeated rows stay; other columns are left out. One scan, no shuffle; parsing keeps one page.
    """
    found = small_batches(pages).select(F.col(id_col).alias(id_col), F.col(url_col).alias(url_col), html_text(F.col(html_col).cast("string")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
