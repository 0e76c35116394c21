"""Main text of web pages by composite text density.

Every DOM node gets a link-adjusted number of characters per tag.  The sum of the densities of its
children tells how much text-like material a node holds directly; the node with the largest sum
begins the core of the article.  The smallest density on the way from that node to ``body`` is the
page's threshold: the core grows by an ancestor as long as what that adds (by itself, adjusted for
links) reaches it, or holds the headline that the core lacks.  An ``article`` or ``main`` element only
settles what the densities leave open: light additions, such as a byline, join a core that already
has most of that element's text.

Elements whose tag or role never holds main text leave none anywhere.  Names (class, id) of page
furniture keep an element out of the densities.  Within the core they decide nothing by
themselves, but for adverts and reader comments: others go only if they are mostly links or lighter
than the threshold.  A list of links goes only in front of the core's first text, or at the end of
``body`` itself without a heading; every other block of the core stays.

Defined cases: a null or empty page has the empty text; broken markup is repaired the way browsers
do (open elements close at the end, paragraphs close at the next block, a tag without an end swallows the
rest).  Page size has no limit; work is linear in it, whatever the markup: open elements are found by
their tag, and no place is searched for the same thing twice.  Rows are independent, so repeated
rows give repeated results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of the HTML standard, by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption optgroup option".split()
)
#: Elements that never hold main text.
DROPPED_TAGS = frozenset(
    "head script style noscript template iframe noembed noframes xmp object svg canvas audio video map nav footer aside form button input select textarea label fieldset dialog menu title".split()
)
#: Roles that never hold main text.
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tablist note".split())
# Names (in class or id) of adverts, reader comments, and other page furniture.
AD_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus".split())
OTHER_NAMES = frozenset(
    "banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs masthead footer topbar toolbar pagination pager cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget skip sitemap copyright hidden reply replies responses respond".split()
)
#: Words of layout that may follow such a name: "ad-box" is an advert, "ad-hoc" is not.
LAYOUT_WORDS = frozenset(
    "box slot unit container wrapper wrap block area inner outer list item items section panel bar top bottom left right module group row col column holder frame thread count links posts articles stories buttons".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of one of these closes an open element of the other kinds, up to a container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
STOPS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}}

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_TAG_END = re.compile("[>\"']")
_ATTR = re.compile(r"([^\s=/\"']+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "parent", "parts", "chars", "tags", "link_chars", "link_tags", "titles", "density", "total", "mark", "wrapper")

    def __init__(self, tag: str, parent: Node | None, mark: str | None = None):
        """``mark``: None, or "never" (holds no main text), "header", "comment", "ad" or "other"."""
        self.tag, self.parent, self.mark = tag, parent, mark
        self.wrapper = False  # named like furniture, but holds the article
        self.parts: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = self.titles = 0
        self.density = self.total = 0.0

    @property
    def aside(self) -> bool:
        """Kept out of the densities."""
        return self.mark is not None and not self.wrapper


def _named(value: str) -> str | None:
    """What a class or id says: a name, maybe behind other words, and words of layout behind it."""
    found = None
    for token in value.split():
        parts = [part.lower() for part in _NAME.findall(token)]
        while len(parts) > 1 and parts[-1] in LAYOUT_WORDS:
            parts.pop()
        if not parts:
            continue
        if parts[-1] in COMMENT_NAMES:
            return "comment"
        if parts[-1] in AD_NAMES:
            found = "ad"
        elif parts[-1] in OTHER_NAMES:
            found = found or "other"
    return found


def _mark(tag: str, attrs: str, inside_article: bool) -> str | None:
    """The mark of an element, by its tag, role, visibility, class and id."""
    if tag in DROPPED_TAGS:
        return "never"
    found = "header" if tag == "header" and not inside_article else None
    if not attrs or tag in ("html", "body"):
        return found
    names = ""
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return "never"
        if name == "style" and "display:none" in value.lower().replace(" ", ""):
            return "never"
        if name == "role" and value.lower() in DROPPED_ROLES:
            return "never"
        if name in ("class", "id"):
            names += f" {value}"
    if names and tag in BLOCK and tag not in HEADINGS and (said := _named(names)):
        if said == "comment" or tag not in ("article", "main"):
            # A paragraph is an advert if a whole class says so, and no other furniture.
            if tag != "p" or (said == "ad" and AD_NAMES & set(names.lower().split())):
                return said
    return found


def parse(html: str) -> Node:
    """The tree of a page.  Furniture is marked, comments and raw elements leave no text."""
    root = Node("#root", None)
    stack, at, end = [root], 0, len(html)
    # Depths of the open elements of each tag, and of open blocks.
    opened: dict[str, list[int]] = {}
    blocks_open: list[int] = []
    none_left = {"\"": False, "'": False}
    quotes = True  # whether tags are read with quoted values; a page where that finds no end is not

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            tag = stack.pop().tag
            opened[tag].pop()
            if tag in BLOCK:
                blocks_open.pop()

    def last(tags) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def tag_end(lo: int) -> int:
        """The place of the ">" that ends a tag, or -1."""
        nonlocal quotes
        pos = lo
        while quotes:
            m = _TAG_END.search(html, pos)
            if m is None:
                quotes = False
                break
            if m[0] == ">":
                return m.start()
            pos = m.end()
            if not none_left[m[0]]:
                stop = html.find(m[0], pos)
                none_left[m[0]] = stop < 0
                pos = max(pos, stop + 1)
        return html.find(">", lo)

    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            stack[-1].parts.append(html[at:lt])
        if lt == end:
            break
        if html.startswith("<!--", lt):
            stop = html.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            stop = html.find(">", lt)
            at = end if stop < 0 else stop + 1
            continue
        m = _OPEN.match(html, lt)
        if m is None:
            stack[-1].parts.append("<")
            at = lt + 1
            continue
        stop = tag_end(m.end())
        if stop < 0:  # nothing ends any tag from here on
            break
        attrs, at, tag = html[m.end() : stop], stop + 1, m[2].lower()
        inline = tag not in BLOCK
        if m[1]:
            depth = last((tag,))
            if depth and not (inline and blocks_open and blocks_open[-1] > depth):
                pop_to(depth)
            continue
        if not inline and tag not in ("html", "body") and blocks_open and stack[blocks_open[-1]].tag == "p":
            pop_to(blocks_open[-1])
        if tag in CLOSES:
            while (depth := last(CLOSES[tag])) > last(STOPS[tag]):
                pop_to(depth)
                if tag not in ("tr", "tbody"):
                    break
        node = Node(tag, stack[-1], _mark(tag, attrs, bool(opened.get("article") or opened.get("main"))))
        stack[-1].parts.append(node)
        if tag in RAW:
            stop = _raw_end(tag).search(html, at)
            at = end if stop is None else (html.find(">", stop.end()) + 1 or end)
        elif tag not in VOID and not attrs.endswith("/"):
            opened.setdefault(tag, []).append(len(stack))
            if not inline:
                blocks_open.append(len(stack))
            stack.append(node)
    return root


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])", re.I)


def _above(node: Node) -> Iterator[Node]:
    while node.parent is not None:
        node = node.parent
        yield node


def _in_order(root: Node) -> list[Node]:
    """The nodes that may hold main text, parents first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(x for x in reversed(node.parts) if isinstance(x, Node) and x.mark != "never")
    return order


def _letters(text: str) -> int:
    return len(text) - text.count(" ") - text.count("\n")


def measure(order: list[Node]) -> Node:
    """Fill in the densities and their sums, from the leaves up; the body."""
    inside: dict[Node, tuple[int, int, int]] = {}  # letters, blocks, headlines and articles
    for node in reversed(order):
        below = [inside[x] for x in node.parts if x in inside]
        letters, n_blocks, heads = (sum(x[k] for x in below) for k in range(3))
        inside[node] = letters + sum(_letters(x) for x in node.parts if isinstance(x, str)), n_blocks + (node.tag in BLOCK), heads + (node.tag in ("h1", "article", "main"))
    letters, n_blocks, _ = inside[order[0]]
    for node in order:
        own = inside[node]
        node.wrapper = node.mark in ("ad", "other") and 2 * own[0] > letters and (own[2] > 0 or (node.mark == "other" and own[1] > 3 and 2 * own[1] > n_blocks))
    for node in reversed(order):
        for x in node.parts:
            if isinstance(x, str):
                node.chars += _letters(x)
            elif not x.aside:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags
                node.titles += x.titles + (x.tag == "h1" and x.chars > 0)
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    body = next((x for x in order if x.tag == "body"), order[0])
    share = body.link_chars / max(1, body.chars)
    for node in order:
        c, t, lc, lt = max(1, node.chars), max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        if node.chars:
            # The logarithm's base grows with the share of linked characters, so it is above 1.
            base = math.log(c / max(1, node.chars - node.link_chars) * lc + share * c + math.e)
            node.density = c / t * max(0.0, math.log(c / lc * t / lt)) / math.log(base)
    for node in order:
        node.total = sum(x.density for x in node.parts if isinstance(x, Node) and not x.aside)
    return body


def core(order: list[Node], body: Node) -> tuple[Node, float]:
    """The article's root, grown from the largest sum of child densities, and the page's threshold."""
    outside = set()  # in furniture
    for x in order:
        if x.aside or x.parent in outside:
            outside.add(x)
    boxes = [x for x in order if x.tag in BLOCK and x not in outside and any(isinstance(y, Node) and y.tag in BLOCK and not y.aside for y in x.parts)]
    if not boxes:
        return order[0], 0.0
    best = max(boxes, key=lambda x: x.total)
    path = [best, *(x for x in _above(best) if x.tag not in ("html", "#root"))]
    threshold = min((x.chars - x.link_chars) / max(1, x.tags) for x in (*path, body))
    named, within = set(), False  # path nodes that are, or lie in, an article or main element
    for node in reversed(path):
        within = within or node.tag in ("article", "main")
        if within:
            named.add(node)
    for node in path[1:]:
        chars, links, tags = node.chars - best.chars, node.link_chars - best.link_chars, node.tags - best.tags - 1
        dense = chars <= 0 or (chars > links and (chars - links) / max(1, tags) >= threshold)
        titled = node.titles > 0 and not best.titles and best.tag != "h1"
        settled = node in named and 2 * best.chars > node.chars
        if not (dense or titled or settled):
            break
        best = node
    return best, threshold


def _leaves(x: Node, threshold: float, whole: bool) -> bool:
    """Whether an element within the core goes; ``whole``: the core is the page itself."""
    if x.mark in ("never", "comment"):
        return True
    if x.mark == "ad":
        return not x.wrapper
    if x.mark == "header":
        return whole
    return x.mark == "other" and not x.wrapper and (2 * x.link_chars > x.chars or x.chars / max(1, x.tags) < threshold)


def _menus(root: Node, threshold: float, whole: bool) -> set[Node]:
    """Boxes of links in front of the core's first text, and at the page's end without a heading."""
    children = [x for x in root.parts if (isinstance(x, Node) and not _leaves(x, threshold, whole)) or (isinstance(x, str) and x.strip())]
    menu = lambda x: isinstance(x, Node) and x.tag in ("ul", "ol", "div", "section", "table", "p") and 2 * x.link_chars > x.chars
    found: set[Node] = set()
    for x in children:
        if not menu(x):
            break
        found.add(x)
    if whole:
        for k in range(len(children) - 1, -1, -1):
            if not menu(children[k]) or (k and isinstance(children[k - 1], Node) and children[k - 1].tag in HEADINGS):
                break
            found.add(children[k])
    return found if len(found) < len(children) else set()


def blocks(root: Node, threshold: float = 0.0) -> Iterator[str]:
    """The text of each block below a node, in page order."""
    whole = root.tag in ("body", "html", "#root")
    gone = _menus(root, threshold, whole)
    held: list[str] = []
    todo: list[Node | str | None] = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            held.append(x)
        elif x is None or x.tag in BLOCK:
            if held and (text := " ".join(unescape("".join(held)).split())):
                yield text
            held = []
            if x is not None and (x is root or not (x in gone or _leaves(x, threshold, whole))):
                todo.append(None)
                todo.extend(reversed(x.parts))
        elif x.tag in ("br", "wbr"):
            held.append(" " if x.tag == "br" else "")
        elif x.mark is None:
            todo.extend(reversed(x.parts))
    if held and (text := " ".join(unescape("".join(held)).split())):
        yield text


def main_text(html: str | None) -> str:
    """The main text of one page, its blocks joined by line feeds."""
    if not html:
        return ""
    order = _in_order(parse(html))
    return "\n".join(blocks(*core(order, measure(order))))


@F.pandas_udf(T.StringType())
def main_text_udf(html: pd.Series) -> pd.Series:
    return html.map(main_text, na_action=None)


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text in column ``into`` (replacing a column of that name)."""
    return pages.withColumn(into, main_text_udf(F.col(html)))


def op1(pages: DataFrame) -> DataFrame:
    out = extract(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
