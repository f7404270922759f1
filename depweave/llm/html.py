"""Main-text extraction by tree scoring: paragraphs pass points to their ancestors, the best container is kept.

Parts whose element is never article text (menus, forms, scripts) and hidden parts are cut out. A part that only its
class, id or role speaks against is cut out too, unless it holds so much of the text that it must be a wrapper of the
article; then it stays with a lower score. Scanning and tree building take time in proportion to the page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without content or end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
#: Elements that are never part of the article.
DROPPED = RAW | frozenset("head nav footer aside form button select option svg canvas object audio video dialog menu map applet math".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: A start tag of the key closes an open element of the value, up to the nearest element of SCOPE.
CLOSES = {
    **dict.fromkeys(BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}, frozenset({"p"})),
    "li": frozenset({"li", "p"}),
    **dict.fromkeys(("dd", "dt"), frozenset({"dd", "dt", "p"})),
    **dict.fromkeys(("td", "th"), frozenset({"td", "th", "p"})),
    "tr": frozenset({"tr", "td", "th", "p"}),
    **dict.fromkeys(("tbody", "thead", "tfoot"), frozenset({"tr", "td", "th", "tbody", "thead", "tfoot", "p"})),
    "option": frozenset({"option"}),
}
SCOPE = {"li": frozenset({"ul", "ol", "menu"}), "dd": frozenset({"dl"}), "dt": frozenset({"dl"}), **dict.fromkeys(("td", "th", "tr", "tbody", "thead", "tfoot"), frozenset({"table"}))}
OUTER = frozenset("html body table td th caption button article section main div".split())
#: Words in class, id or role of parts that are not the article.
UNLIKELY = frozenset("ad ads adbox adsbygoogle adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars menu menubar nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments disqus replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended widget toolbar pager pagination complementary contentinfo search login skip hidden dialog".split())
#: Of UNLIKELY, words of parts that may well be longer than the article.
NEVER = frozenset("comment comments disqus replies respond nav navbar navigation menu sidebar sidebars footer recommended cookie cookies consent".split())
#: Of those, words that a wrapper of the article may carry too ("content-with-sidebar"): they do not count beside a word of LIKELY.
WEAK = frozenset("sidebar sidebars widget hidden banner page".split())
LIKELY = frozenset("article articlebody body content entry main page post story text".split())

#: A comment, declaration or tag. As browsers do, a value without quotes may hold quotes, and one with quotes may hold
#: ">"; a quote that is never closed counts as part of a value without quotes, so that the page's text is not lost.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+{_VALUE})*+)(?:>|\Z)", re.S)
_ATTR = re.compile(rf"([^\s/>=]++)(?:\s*+=\s*+({_VALUE}))?", re.S)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_COMMA = re.compile("[,，、،]")


#: Shares of the text from which a part with a word of UNLIKELY is taken for a wrapper: in general, and with a word of NEVER.
WRAPS, SURELY_WRAPS = 0.5, 0.9
PENALTY = 5.0
#: Ancestors that a paragraph passes points to; the next would get less than a hundredth.
LEVELS = 32


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "against", "weight", "size", "linked", "score", "commas")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        self.size = self.linked = self.commas = 0
        self.score, self.dropped, self.weight = 0.0, tag in DROPPED, 25.0 if tag in ("article", "main") else 0.0
        #: The words of class, id and role that speak against the part.
        self.against: frozenset[str] = frozenset()
        if attrs and not attrs.isspace():
            for name, value in _ATTR.findall(attrs):
                name, value = name.lower(), value.strip("\"'")
                if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _HIDDEN.search(value):
                    self.dropped = True
                elif name in ("class", "id", "role"):
                    words = {w.lower() for w in _WORD.findall(value)}
                    found = words & (UNLIKELY - WEAK if words & LIKELY else UNLIKELY)
                    if found and tag not in ("html", "body", "article", "main") and not (tag in HEADING or tag == "p" and not words & {"ad", "ads", "advert", "notice", "cookie", "sponsored"}):
                        self.against |= found
                    if words & LIKELY:
                        self.weight += 5.0


def parse(html: str) -> Node:
    """A tree of Nodes and text strings. Unclosed and stray tags are repaired as browsers do for blocks."""
    root = Node("#root", None)
    at, here, end = 0, root, len(html)
    open_tags: Counter[str] = Counter()

    def close_to(node: Node) -> Node:
        """Everything from here up to the node is closed; what holds it is open again."""
        up = here
        while up is not node.parent:
            open_tags[up.tag] -= 1
            up = up.parent
        return up

    while at < end:
        m = _TOKEN.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            here.children.append(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            up = here if open_tags[tag] else root
            while up is not root and up.tag != tag and not (up.tag in OUTER and tag not in BLOCK):
                up = up.parent
            if up is not root and up.tag == tag:
                here = close_to(up)
            continue
        if (closes := CLOSES.get(tag)) and any(open_tags[x] for x in closes):
            stop, up, found = SCOPE.get(tag, OUTER), here, None
            while up is not root and up.tag not in stop:
                found = up if up.tag in closes else found
                up = up.parent
            here = close_to(found) if found is not None else here
        if tag in HEADING and here.tag in HEADING:
            here = close_to(here)
        node = Node(tag, here, m[3])
        here.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = close.end() if close else end
        elif tag not in VOID and not m[3].endswith("/"):
            here = node
            open_tags[tag] += 1
    return root


def _has_heading(node: Node) -> bool:
    return any(not isinstance(x, str) and x.tag in HEADING for x in node.children)


def _prune(root: Node) -> None:
    """Cut out what cannot be article text. A header inside an article stays if it holds a heading and no menu."""
    doubtful = _cut(root, lambda node, inside: node.dropped or node.tag == "header" and not node.against and not (inside and _has_heading(node)))
    if not doubtful:
        return
    _measure(root)
    total = root.size

    def goes(node: Node, inside: bool) -> bool:
        if not node.against:
            return False
        if "header" in node.against and not node.against & NEVER and _has_heading(node) and (inside or node.weight > 0):
            return False
        if node.size > total * (SURELY_WRAPS if node.against & NEVER else WRAPS) and density(node) < 0.5:
            node.weight -= PENALTY
            return False
        return True

    _cut(root, goes)


def _cut(root: Node, goes: Callable[[Node, bool], bool]) -> bool:
    """Take out the nodes for which goes(node, inside an article) holds; whether words speak against any that is left."""
    todo, doubtful = [(root, False)], False
    while todo:
        node, inside = todo.pop()
        kept = []
        for child in node.children:
            if isinstance(child, str):
                kept.append(child)
            elif not goes(child, inside):
                kept.append(child)
                doubtful = doubtful or bool(child.against)
                todo.append((child, inside or child.tag in ("article", "main")))
        node.children = kept
    return doubtful


def _measure(root: Node) -> list[Node]:
    """Sizes, link sizes and commas of all nodes; the nodes in page order."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        node.size = node.linked = node.commas = 0
        order.append(node)
        todo.extend(c for c in reversed(node.children) if not isinstance(c, str))
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                text = " ".join(unescape(c).split())
                node.size += len(text)
                node.commas += len(_COMMA.findall(text))
            else:
                node.size += c.size
                node.linked += c.linked
                node.commas += c.commas
        if node.tag == "a":
            node.linked = node.size
    return order


def _is_paragraph(node: Node) -> bool:
    """Holds text that is its own: no block below it, or text beside its blocks."""
    blocks = [c for c in node.children if not isinstance(c, str) and c.tag in BLOCK]
    if node.tag not in BLOCK or node.tag in ("html", "body"):
        return False
    return node.size > 0 and (not blocks or any(isinstance(c, str) and c.strip() for c in node.children))


def density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def main_container(order: list[Node]) -> list[Node]:
    """The best container and the siblings kept with it, in page order; empty if the page has no text."""
    candidates: dict[int, Node] = {}
    for node in order:
        if not _is_paragraph(node) or node.tag in HEADING:
            continue
        points = 1 + node.commas + min(node.size / 100, 3)
        up, level = node.parent, 0
        while up is not None and up.tag != "#root" and level < LEVELS:
            if id(up) not in candidates:
                candidates[id(up)] = up
                up.score += up.weight
            up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.parent, level + 1
    ranked = [(c.score * (1 - density(c)), -i, c) for i, c in enumerate(candidates.values())]
    if not ranked:
        loose = [n for n in order if n.tag == "body"] or order[:1]
        return [n for n in loose if n.size and density(n) < 0.5]
    score, _, best = max(ranked, key=lambda x: x[:2])
    parent = best.parent
    if parent is None or best.tag in ("html", "body"):
        return [best]
    limit, out = max(10.0, 0.2 * score), []
    for c in parent.children:
        if isinstance(c, str):
            continue
        own = c.score * (1 - density(c)) if id(c) in candidates else 0.0
        prose = c.tag in ("p", "pre", "blockquote", "section", "article") and density(c) < 0.25 and c.size > 80
        if c is best or (c.tag in HEADING and c.size) or own >= limit and density(c) < 0.5 or prose:
            out.append(c)
    return out


def blocks_of(nodes: list[Node]) -> list[str]:
    out, line = [], []

    def flush() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            out.append(text)

    for top in nodes:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                line.append(unescape(x))
            elif x is None:
                flush()
            elif x.tag in ("br", "wbr"):
                line.append(" " if x.tag == "br" else "")
            else:
                if x.tag in BLOCK:
                    flush()
                    todo.append(None)
                todo.extend(reversed(x.children))
        flush()
    return out


def extract(html: str | None) -> str:
    """The main text: blocks in page order joined by \\n; '' for null, empty or text-free pages."""
    if not html:
        return ""
    root = parse(html)
    _prune(root)
    return "\n".join(blocks_of(main_container(_measure(root))))


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with a column `text`, the main text (an earlier `text` is replaced). Rows are independent: no shuffle."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([extract(x) for x in batch], dtype=object)

    return pages.withColumn("text", run(F.col(html_col)))
