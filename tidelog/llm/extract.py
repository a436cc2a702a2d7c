"""Main text of HTML pages by composite text density (after Sun, Song and Liao, 2011).

Every node's density is its characters per tag, corrected for the share of link characters and tags.
A node's density sum adds the densities of its children. The node with the largest sum holds the main
text; the least density on its path to the body is the threshold, and other nodes at or above it give
the best subtree below them. What tags, class, id or role call navigation, adverts, notices, comments and
the like is left out where density does not say otherwise: see `leave_out`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.common import spread

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("optgroup", "option"), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "thead": ("tbody", "tfoot"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist"), "optgroup": ("select",)}
#: Elements whose content is not shown as text, or is a page's frame by the standard.
NEVER = frozenset("head script style noscript template nav footer aside button select textarea input iframe svg math canvas object audio video dialog menu search title".split())
#: Names of what is not main text.
READERS = frozenset("comment comments commentlist disqus reply replies respond".split())
NAMES = READERS | frozenset("ad ads adv advert adverts advertisement advertising adsense adslot banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar side-bar sidenav aside footer masthead topbar header site-header cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget pagination pager toolbar search hidden".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
WHOLE = frozenset("html body article main".split())  # names on the outermost of these say nothing

_OPEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
_QUOTED = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")  # only after = does a quote hold a >
_NAMED = re.compile(r"(?:^|\s)(class|id|role|style|aria-hidden|hidden)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?(?=[\s/]|$)", re.I)
_SPLIT = re.compile(r"[\s_]+")

FREE, WEAK, STRONG, COMMENT, HARD = range(5)  # how surely a node is no main text, by what it is called


class Node:
    __slots__ = ("chars", "density", "items", "link_chars", "link_tags", "out", "parent", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, out: int = FREE):
        self.tag, self.parent, self.out = tag, parent, out
        self.items: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def called(tag: str, attributes: str, within: bool) -> int:
    """What an element's tag and attributes say of it. within: it stands inside an article or main element.

    A whole word of class or id, hyphenated of such words or not (cookie-notice), a role or a mark as hidden
    is a strong hint, the first or last part of another hyphenated word (with-sidebar) a weak one; so is a form, which may hold the whole page.
    """
    if tag in NEVER:
        return HARD
    if tag == "header":
        return FREE if within else STRONG
    out = WEAK if tag == "form" else FREE
    if tag in ("html", "body") or not attributes.strip():
        return out
    for name, a, b, c in _NAMED.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "") or name == "role" and value in ROLES:
            out = max(out, STRONG)
        elif name in ("class", "id"):
            for word in _SPLIT.split(value):
                if word in READERS:
                    out = COMMENT
                elif tag in WHOLE and not within:
                    continue
                elif all(x in NAMES for x in word.split("-")) or word in NAMES:
                    out = max(out, STRONG)
                elif word.partition("-")[0] in NAMES or word.rpartition("-")[2] in NAMES:
                    out = max(out, WEAK)
    return out


def _tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, name, whether closing, and attributes of every tag; name "" for comments and declarations.

    One pass: beyond the last > there are no tags; a quote that never ends is found once, and from there on
    quotes say nothing. Content of raw text elements is skipped to their end tags.
    """
    last, quotes, at = html.rfind(">") + 1, True, 0
    while m := _OPEN.search(html, at, last):
        if m[1] or m[2]:
            end = html.find("-->", m.start() + 2) if m[1] else html.find("]]>", m.end())  # <!--> is empty
            at = len(html) if end < 0 else end + 3
            yield m.start(), at, "", False, ""
            continue
        if m[4] is None:
            at = html.find(">", m.end()) + 1
            yield m.start(), at, "", False, ""
            continue
        end = _QUOTED.match(html, m.end(), last) if quotes else None
        quotes = end is not None
        at = end.end() if end else html.find(">", m.end()) + 1
        tag, closing = m[4].lower(), bool(m[3])
        attributes = html[m.end() : at - 1]
        if tag in RAW and not closing:
            close = re.compile(f"</{tag}", re.I).search(html, at)
            to = html.find(">", close.end()) + 1 if close else 0
            yield m.start(), to or len(html), tag, False, attributes
            at = to or len(html)
        else:
            yield m.start(), at, tag, closing, attributes


def parse(html: str) -> Node:
    """The tree of a page: text, blocks, links and inline marks, with what each is called. Time and memory are in proportion to the page."""
    root = Node("html", None)
    stack, blocks_at = [root], [0]
    places: dict[str, list[int]] = {}  # of open elements in the stack, by tag

    def close(to: int) -> None:
        for n in reversed(stack[to:]):
            places[n.tag].pop()
            if n.tag in BLOCKS:
                blocks_at.pop()
        del stack[to:]

    def last(tags: Iterable[str]) -> int:
        return max((p[-1] for t in tags if (p := places.get(t))), default=-1)

    at = 0
    for start, end, tag, closing, attributes in _tags(html):
        if start > at:
            stack[-1].items.append(unescape(html[at:start]))
        at = end
        if not tag:
            continue
        if closing:
            place = last((tag,))
            if place > 0 and (tag in BLOCKS or place > blocks_at[-1]):
                close(place)
            continue
        if tag in RAW:
            if tag not in NEVER:
                stack[-1].tags += 1
            continue
        if tag == "html" or tag == "body" and places.get("body"):
            continue
        if tag in BLOCKS:
            if stack[blocks_at[-1]].tag == "p":
                close(blocks_at[-1])
            if tag in CLOSES and (place := last(CLOSES[tag])) > last(SCOPES.get(tag, ("table",))):
                close(place)
        node = Node(tag, stack[-1], called(tag, attributes, bool(places.get("article") or places.get("main"))))
        stack[-1].items.append(node)
        if tag not in VOID:
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCKS:
                blocks_at.append(len(stack))
            stack.append(node)
    if at < len(html):
        stack[-1].items.append(unescape(html[at:]))
    return root


def strip(root: Node, drop: Callable[[Node], bool]) -> None:
    """Take the subtrees out whose top drop says so of."""
    todo = [root]
    while todo:
        n = todo.pop()
        if any(isinstance(x, Node) and drop(x) for x in n.items):
            n.items = [x for x in n.items if not (isinstance(x, Node) and drop(x))]
        todo.extend(x for x in n.items if isinstance(x, Node))


def _order(root: Node) -> list[Node]:
    """Nodes in page order, parents before children."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(x for x in reversed(n.items) if isinstance(x, Node))
    return out


def measure(root: Node) -> list[Node]:
    """Fill in the counts, densities and sums; the nodes in page order.

    Blocks and links count as tags. Inline marks such as b or br do not: a page may leave them open, and
    they say nothing about what a block is for.

    density = C / T * log((C / LC) * (T / LT)) to the base 1 + ln(C / (C - LC) * LC + LCb / Cb * C + e), with C
    characters, T tags, L those of links and b the body's; counts of zero are taken as one. (The paper
    has no 1 + in the base, which is then 1, and the logarithm undefined, on pages without links.)
    """
    nodes = _order(root)
    for n in reversed(nodes):
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        for x in n.items:
            if isinstance(x, Node):
                n.chars += x.chars
                n.tags += x.tags + (x.tag in BLOCKS or x.tag == "a")
                n.link_chars += x.link_chars
                n.link_tags += x.link_tags
            else:
                n.chars += len(x) - sum(map(x.count, " \t\n\r\f"))
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.tags + 1
    body = next((n for n in nodes if n.tag == "body"), root)
    ratio = body.link_chars / body.chars if body.chars else 0.0
    for n in nodes:
        if n.chars:
            tags, lc, lt = max(n.tags, 1), max(n.link_chars, 1), max(n.link_tags, 1)
            scale = n.chars / max(n.chars - n.link_chars, 1) * n.link_chars + ratio * n.chars + math.e
            n.density = n.chars / tags * math.log(max(n.chars / lc * tags / lt, 1.0)) / math.log(1 + math.log(scale))
    for n in nodes:
        n.sum = sum(x.density for x in n.items if isinstance(x, Node) and x.tag in BLOCKS)
    return nodes


def best_of(nodes: list[Node]) -> Node:
    """The node of the largest density sum, the first of equals; the root if all are zero."""
    best = max(nodes, key=lambda n: n.sum)
    return best if best.sum > 0 else nodes[0]


def _with_all_above(nodes: Iterable[Node]) -> set[int]:
    """The ids of the nodes and of all that hold them."""
    out: set[int] = set()
    for n in nodes:
        while n is not None and id(n) not in out:
            out.add(id(n))
            n = n.parent
    return out


def leave_out(root: Node) -> list[Node]:
    """Strip what is no main text, where density does not say otherwise; the measured nodes that remain.

    1. What is called so for certain goes, but not what holds an article or main element or, on a page
       without those, most of the text outside links and the node of the largest density sum. What is called
       a comment and holds no article goes in any case.
    2. If no text is left by that, only unseen elements and the page's frame go.
    3. Of the rest, what is called so goes unless it holds the node of the largest density sum, an article
       or main element or, on a page without those, most of the text outside links.
    """
    strip(root, lambda n: n.out == HARD)
    nodes = measure(root)
    if all(n.out == FREE for n in nodes):
        return nodes
    talk: set[int] = set()
    for n in nodes:  # parents first
        if n.out == COMMENT or id(n.parent) in talk:
            talk.add(id(n))
    inside = [n for n in nodes if n.tag in ("article", "main") and n.out == FREE and id(n) not in talk]
    holds = _with_all_above(inside)
    most = (root.chars - root.link_chars) / 2

    def kept(n: Node) -> bool:
        return id(n) in holds or not inside and n.chars - n.link_chars > most

    best = _with_all_above([best_of(nodes)])
    sure = {id(n) for n in nodes if n.out == COMMENT and id(n) not in holds or n.out == STRONG and not (kept(n) and (id(n) in holds or id(n) in best))}
    gone: set[int] = set()
    for n in nodes:  # parents first
        if id(n) in sure or id(n.parent) in gone:
            gone.add(id(n))
    if any(id(n) not in gone and any(isinstance(x, str) and x.strip() for x in n.items) for n in nodes):
        strip(root, lambda n: id(n) in sure)
        nodes = measure(root)
        most = (root.chars - root.link_chars) / 2
    best = _with_all_above([best_of(nodes)])
    rest = {id(n) for n in nodes if n.out != FREE and id(n) not in best and not kept(n)}
    if rest:
        strip(root, lambda n: id(n) in rest)
        nodes = measure(root)
    return nodes


def main_nodes(root: Node) -> list[Node]:
    """The subtrees that hold the main text, in page order, none inside another."""
    nodes = leave_out(root)
    if len(nodes) == 1 or not root.chars:
        return [root] if root.chars else []
    best = best_of(nodes)
    if best is root:
        return [root]
    threshold, up = best.density, best
    while up is not None and up.tag != "html":
        threshold, up = min(threshold, up.density), up.parent
    above = _with_all_above([best.parent])
    chosen, inside = {id(best)}, set()
    for n in nodes:  # parents first
        if n.parent is not None and (id(n.parent) in chosen or id(n.parent) in inside):
            inside.add(id(n))
        elif id(n) not in above and n.tag in BLOCKS and n.chars and n.density >= threshold:
            chosen.add(id(n))
    return [n for n in nodes if id(n) in chosen and id(n) not in inside]


def blocks(node: Node) -> Iterator[str]:
    """Text of each block under node, white space collapsed, empty ones left out."""
    parts: list[str] = []
    todo: list[tuple[Node | str | None, bool]] = [(node, False)]
    while todo:
        x, ended = todo.pop()
        if isinstance(x, str):
            parts.append(x)
            continue
        if x.tag in BLOCKS:
            if text := " ".join("".join(parts).split()):
                yield text
            parts = []
        elif x.tag == "br" and not ended:
            parts.append(" ")
        if not ended:
            todo.append((x, True))
            todo.extend((y, False) for y in reversed(x.items))
    if text := " ".join("".join(parts).split()):
        yield text


def main_text(html: str | None) -> str:
    """The main text of a page: its blocks in page order, joined by line feeds; empty for null, empty and markup-only pages."""
    return "\n".join(t for n in main_nodes(parse(html or "")) for t in blocks(n))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page, from the whole html; one pass, no shuffle unless a scan has too few splits.

    Null html is empty and gives empty text, as does a page without text. Repeated rows and nulls in
    page_id or url stay as they are; other columns play no part, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                texts = [main_text(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return spread(pages.select(pages["page_id"].cast("long").alias("page_id"), "url", "html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
