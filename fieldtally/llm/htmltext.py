"""Main text of web pages by tree scoring.

Paragraphs pass points for length and commas to their ancestors, discounted by
link density. The best container leads to the article: the `article` or `main` around it, or, on pages without either, the
container with all its surroundings that are not link lists. All of that is kept but the parts that are menus, headers, footers,
sidebars, notices, adverts, forms or comments by their element, role or class. Class names that articles use
too (WEAK) count against a part only outside the article, or where links make up most of its text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.batches import small_batches

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^>]*\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
# Element names of HTML.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td"
    " tfoot th thead tr ul".split()
)
CLOSES = {  # start tags that end an open element of the given names, up to a boundary
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
DROPPED = frozenset("nav footer aside form button select fieldset dialog menu head search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
WEAK = frozenset("banner discussion foot form head header legal masthead promotion reply respond search share sharing skip social widget".split())
UNWANTED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice"
    " notices notification alert sidebar comment comments commentlist discussion disqus replies reply respond menu nav navbar navigation"
    " breadcrumb breadcrumbs pagination pager footer foot header masthead topbar toolbar share sharing social related recommended newsletter"
    " subscribe subscription signup login popup modal overlay widget skip copyright legal form search".split()
)
_NAMES = re.compile(r"[a-z]+|[A-Z][a-z]*")
PARAGRAPHS = frozenset("p pre h1 h2 h3 h4 h5 h6 li blockquote".split())
LISTS = frozenset("ul ol dl table div section".split())
BASE = {"article": 25.0, "main": 20.0, "section": 3.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0, "ul": -3.0, "ol": -3.0, "li": -3.0}


class Node:
    __slots__ = ("name", "parent", "dropped", "weak", "article", "score", "chars", "linked", "gone", "inside")

    def __init__(self, name: str, parent: Node | None, dropped: bool = False, weak: bool = False):
        self.name, self.parent, self.dropped, self.weak = name, parent, dropped, weak
        self.article = name in ("article", "main") or parent is not None and parent.article
        self.score, self.chars, self.linked = 0.0, 0, 0
        self.gone = self.inside = False

    @property
    def link_share(self) -> float:
        return self.linked / self.chars if self.chars else 0.0


def _unwanted(name: str, attributes: str, parent: Node) -> tuple[bool, bool]:
    """Whether an element is certainly no part of an article, and whether its class makes that likely."""
    if name in DROPPED or name == "header" and not parent.article:
        return True, False
    if not attributes or name in ("html", "body", "article", "main") and "comment" not in attributes:
        return False, False
    weak = False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in ROLES:
            return True, False
        if key in ("class", "id"):
            found = UNWANTED.intersection(w.lower() for w in _NAMES.findall(value))
            if not found <= WEAK:
                return True, False
            weak = weak or bool(found)
    return False, weak


def parse(html: str) -> tuple[list[tuple[Node, str, int]], list[Node]]:
    """Text blocks in page order (innermost block element, text, characters in links) and all block elements."""
    root = Node("#", None)
    stack, nodes, blocks = [root], [root], []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    anchors, linked, at, end = 0, 0, 0, len(html)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            node = stack[-1]
            if text and not node.dropped:
                blocks.append((node, text, min(linked, len(text))))
        linked = 0

    def close(depth: int) -> None:
        flush()
        opened.subtract(n.name for n in stack[depth:])
        del stack[depth:]

    while at < end:
        m = _TOKEN.search(html, at)
        stop = m.start() if m else end
        if stop > at:
            text = html[at:stop]
            parts.append(unescape(text) if "&" in text else text)
            if anchors:
                linked += len(parts[-1].strip())
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attributes = name.lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if closing:
            if name == "a":
                anchors = max(0, anchors - 1)
            elif name in BLOCKS:
                if opened[name]:
                    depth = len(stack) - 1
                    while stack[depth].name != name:
                        depth -= 1
                    close(depth)
                    anchors = 0
                else:
                    flush()
            continue
        if name == "br":
            parts.append(" ")
        elif name in RAW:
            found = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            at = found.end() if found else end
        elif name == "a":
            anchors = 1
        elif name in BLOCKS:
            if name in CLOSES:
                ended, bounds = CLOSES[name]
                if any(opened[e] for e in ended):
                    for depth in range(len(stack) - 1, 0, -1):
                        if stack[depth].name in bounds:
                            break
                        if stack[depth].name in ended:
                            close(depth)
            elif len(stack) > 1 and stack[-1].name == "p":
                close(len(stack) - 1)
            flush()
            anchors = 0
            if name not in VOID:
                parent = stack[-1]
                dropped, weak = (True, False) if parent.dropped else _unwanted(name, attributes, parent)
                nodes.append(Node(name, parent, dropped, weak))
                stack.append(nodes[-1])
                opened[name] += 1
    flush()
    return blocks, nodes


def _score(blocks: list[tuple[Node, str, int]], nodes: list[Node]) -> None:
    for node, text, linked in blocks:
        node.chars += len(text)
        node.linked += linked
        points = 1.0 + text.count(",") + min(len(text) / 100, 3.0) if len(text) >= 25 else len(text) / 100
        points *= 1 - linked / len(text)
        holder = node.parent if node.name in PARAGRAPHS and node.parent else node
        for share in (1.0, 0.5, 1 / 3, 0.25, 0.2):
            if holder is None:
                break
            holder.score += points * share
            holder = holder.parent
    for node in reversed(nodes):  # children come after their parents
        if node.parent:
            node.parent.chars += node.chars
            node.parent.linked += node.linked


def _article(nodes: list[Node]) -> tuple[Node, bool]:
    """The container of the article, and whether an element says so."""
    apart: dict[int, bool] = {}
    for n in nodes:  # within a part whose class is unwanted outside articles
        apart[id(n)] = n.parent is not None and (apart[id(n.parent)] or n.weak and not n.parent.article)
    able = [n for n in nodes if n.chars and not n.dropped and not apart[id(n)] and n.name not in PARAGRAPHS]
    if not able:
        return nodes[0], False
    best = max(able, key=lambda n: (n.score + BASE.get(n.name, 0.0)) * (1 - n.link_share))
    article = main = None
    holder: Node | None = best
    while holder:
        if holder.name == "article":
            article = holder
        elif holder.name == "main" and main is None:
            main = holder
        holder = holder.parent
    if article and main:
        # the title may lie beside the article; other articles and link lists may not
        others = main.chars - article.chars
        below = {id(article)}
        for n in nodes:
            if id(n.parent) in below:
                below.add(id(n))
        alone = not any(n.name == "article" and n.chars and not n.dropped and id(n) not in below for n in nodes)
        if alone and id(main) not in below and main.linked - article.linked <= 0.5 * others:
            return main, True
        return article, True
    return article or main or best, bool(article or main)


def extract(html: str | None) -> str:
    """Main text of one page: its blocks in page order, joined by a line feed; empty if there is none."""
    blocks, nodes = parse(html or "")
    if not blocks:
        return ""
    _score(blocks, nodes)
    container, named = _article(nodes)
    for n in nodes:
        above = n.parent
        n.inside = n is container or above is not None and above.inside
        n.gone = above is not None and above.gone
        linked = n.link_share > 0.5
        if n.weak and (linked or not n.inside):
            n.gone = True
        elif linked and n.name in LISTS and not (named and n.inside) and n is not container:
            n.gone = True
    titles = {id(n) for n in nodes if n.name == "h1" and named and n.parent is container.parent}
    return "\n".join(text for node, text, _ in blocks if not node.gone and (node.inside or not named or id(node) in titles))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row; null html counts as empty and gives an empty text.

    Null or repeated page_ids keep their rows, extra columns are ignored, no rows give none. Pages of any length and depth are
    read whole, in time linear in both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([extract(h) for h in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], names=["page_id", "url", "text"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return small_batches(own).mapInArrow(run, "page_id long, url string, text string")
