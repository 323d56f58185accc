"""Main text of web pages by composite text density.

A page is read into a tree of elements. Parts that are never article text by their
element, role, class or id (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments) are left out. For every remaining node the density is
its characters per tag, adjusted by the share of characters and tags in links; a node's
density sum is the sum over its children. The node with the largest sum is the core, the
least density on the path from it to the body is the threshold, and the core is completed
by the best node of every branch that reaches it. Where a page marks ``article`` elements
(or else ``main``), the outermost of those that reach the threshold are the result instead
if they hold more than half of the text so found; otherwise the marks count for nothing.

Text is decoded after the markup is cut; blocks end at block elements and line breaks,
white space inside a block becomes one space, blocks are joined by one space. Nothing is
capped: unclosed, crossed and truncated markup is repaired as a browser would.

Defined results: null and empty pages and pages without text give an empty text; a tag cut
off by the end of the page is dropped; repeated pages are treated alike; an empty table
gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import query, table

_TOKEN = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*>))""", re.S
)
_CUT_OFF = re.compile(r"<[A-Za-z/!?][^>]*\Z")
_NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe template svg math xmp noembed noframes".split())
_LEFT_OUT = frozenset(
    "head script style title noscript template iframe object svg math canvas audio video map "
    "nav header footer aside form button select textarea datalist dialog menu menuitem xmp noembed noframes".split()
)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr img".split()
)
_BOUNDARY = frozenset("html body table td th caption article main section div".split())
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "a": ({"a"}, {"td", "th", "table"}),
}
_ARTICLE = frozenset(("article", "main"))
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
# Parts of class names and ids that mark what is around an article.
_ASIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adsense|advert\w*|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notice|notification|alert|"
    r"popup|pop-up|modal|overlay|sidebar\w*|side-bar|aside|menu\w*|nav|navbar\w*|navigation|breadcrumbs?|masthead|"
    r"site-?header|page-?header|header|footer\w*|comments?|commentlist|reader-?comments?|respond|replies|disqus\w*|"
    r"share|sharing|social|related|recommend\w*|newsletter\w*|subscribe\w*|signup|login|search\w*|widget\w*|"
    r"toolbar|pager|pagination|skip-?link|copyright)(?:$|[\s_-])",
    re.I,
)
# Of these, the ones that an article or main element is not the article with; the others tell of its layout.
_NOT_ARTICLE = re.compile(r"comment|(?:^|[\s_-])(?:ads?|adsense|advert\w*|sponsor\w*|promo\w*|related|recommend\w*)(?:$|[\s_-])", re.I)
_ARTICLE_PART = re.compile(r"(?:^|[\s_-])(?:article|entry|post|content|story)(?:$|[\s_-])", re.I)


def _is_aside(tag: str, attributes: str, forms: bool) -> bool:
    if tag in _LEFT_OUT and not (forms and tag == "form"):
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for match in _NAMES.finditer(attributes):
        name, value = match[1].lower(), match[2] or match[3] or match[4] or ""
        if name == "hidden":
            return True
        if name == "aria-hidden":
            if value.lower() == "true":
                return True
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        elif name == "role":
            if value.lower() in _ASIDE_ROLES:
                return True
        elif tag not in ("html", "body") and (found := _ASIDE_NAMES.search(value)):
            own_header = "header" in found[0].lower() and _ARTICLE_PART.search(value)
            if not own_header and (tag not in _ARTICLE or _NOT_ARTICLE.search(value)):
                return True
    return False


class _Tree:
    """Elements in page order; ``pieces`` holds text with the node it stands in, None marks the end of a block."""

    def __init__(self):
        self.tags, self.parent = ["html"], [-1]
        self.chars, self.link_chars, self.n_links = [0], [0], [0]
        self.pieces: list[tuple[int, str] | None] = []

    def add(self, tag: str, parent: int) -> int:
        self.tags.append(tag)
        self.parent.append(parent)
        self.chars.append(0)
        self.link_chars.append(0)
        self.n_links.append(0)
        return len(self.tags) - 1


def _parse(page: str, forms: bool = False) -> _Tree:
    tree = _Tree()
    # open elements: tag, node (-1 when left out), inside a link
    stack = [("html", 0, False)]
    at, size = 0, len(page)

    def text(piece: str) -> None:
        _, node, linked = stack[-1]
        if node < 0 or not piece:
            return
        if "&" in piece:
            piece = entities.unescape(piece)
        tree.pieces.append((node, piece))
        n = len(piece.strip())
        tree.chars[node] += n
        if linked:
            tree.link_chars[node] += n

    while at < size:
        match = _TOKEN.search(page, at)
        if match is None:
            rest = page[at:]
            cut = _CUT_OFF.search(rest)
            text(rest[: cut.start()] if cut else rest)
            break
        text(page[at : match.start()])
        at = match.end()
        tag = match[2]
        if tag is None:
            continue
        tag = tag.lower()
        block = tag not in _INLINE
        if block:
            tree.pieces.append(None)
        if match[1]:
            for k in range(len(stack) - 1, 0, -1):
                name = stack[k][0]
                if name == tag:
                    del stack[k:]
                    break
                if not block and name not in _INLINE:
                    break  # an inline end tag does not close the blocks around it
            continue
        if tag in ("html", "body", "head") and any(s[0] == tag for s in stack):
            continue
        if tag in _CLOSES or block and tag not in ("br",):
            closing, stop = _CLOSES.get(tag, ({"p"}, _BOUNDARY))
            for k in range(len(stack) - 1, 0, -1):
                name = stack[k][0]
                if name in closing:
                    del stack[k:]
                    break
                if name in stop or (closing == {"p"} and name not in _INLINE):
                    break
        _, parent, linked = stack[-1]
        attributes = match[3][:-1]
        aside = _is_aside(tag, attributes, forms)
        if tag == "body" and parent < 0:  # an unclosed head
            stack[1:] = []
            _, parent, linked = stack[-1]
        if parent < 0 and tag in _ARTICLE and not aside:
            parent = next(s[1] for s in reversed(stack) if s[1] >= 0)
        node = -1 if aside or parent < 0 else tree.add(tag, parent)
        if tag == "a" and node >= 0:
            linked = True
            tree.n_links[node] += 1
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag not in _VOID and not attributes.endswith("/") or tag in _ARTICLE:
            stack.append((tag, node, linked))
    return tree


def _densities(tree: _Tree) -> tuple[list[float], list[float]]:
    """Composite density of every node, and the sum of its children's."""
    n = len(tree.tags)
    chars, link_chars, links, tags = list(tree.chars), list(tree.link_chars), list(tree.n_links), [0] * n
    parent = tree.parent
    for k in range(n - 1, 0, -1):
        up = parent[k]
        chars[up] += chars[k]
        link_chars[up] += link_chars[k]
        links[up] += links[k]
        tags[up] += tags[k] + 1
    body_share = link_chars[0] / max(chars[0], 1)
    density, total = [0.0] * n, [0.0] * n
    for k in range(n):
        c = chars[k]
        if not c:
            continue
        t, lc, lt = max(tags[k], 1), max(link_chars[k], 1), max(links[k], 1)
        base = math.log(c / max(c - link_chars[k], 1) * link_chars[k] + body_share * c + math.e)
        ratio = c / lc * t / lt
        density[k] = c / t * (math.log(max(ratio, 1.0)) / math.log(base) if base > 1 else math.log(max(ratio, 1.0)))
    for k in range(1, n):
        total[parent[k]] += density[k]
    return density, total


def _best(tree: _Tree, density: list[float], total: list[float]) -> list[int]:
    """In each node's subtree, the node of the largest density sum (leaves: their own density)."""
    best = list(range(len(density)))
    value = [total[k] or density[k] * 1e-9 for k in best]
    for k in range(len(best) - 1, 0, -1):
        up = tree.parent[k]
        if value[k] >= value[up]:
            value[up], best[up] = value[k], best[k]
    return best


def _marked(tree: _Tree, dense: list[int]) -> set[int]:
    """Of the dense nodes the outermost ``article`` elements, or else the outermost ``main``."""
    for tag in ("article", "main"):
        holders = {k for k in dense if tree.tags[k] == tag}
        if holders:
            inner = _within(tree, holders)
            return {k for k in holders if not inner[tree.parent[k]]}
    return set()


def _within(tree: _Tree, chosen: set[int]) -> list[bool]:
    """Whether each node is one of the chosen or inside one."""
    within = [False] * len(tree.tags)
    for k in range(len(within)):
        within[k] = k in chosen or (k > 0 and within[tree.parent[k]])
    return within


def main_text(page: str) -> str:
    """The article text of one page."""
    tree = _parse(page)
    if not any(tree.chars):  # some sites wrap the whole page in one form
        tree = _parse(page, forms=True)
    if not any(tree.chars):
        return ""
    density, total = _densities(tree)
    best = _best(tree, density, total)
    n = len(density)
    k, threshold = best[0], math.inf
    while k >= 0:
        threshold = min(threshold, density[k])
        k = tree.parent[k]
    chosen, reached = set(), [False] * n
    for k in range(n):
        if density[k] >= threshold and (k == 0 or reached[tree.parent[k]]):
            reached[k] = True
            chosen.add(best[k])
    marked = _marked(tree, [k for k in range(n) if density[k] >= threshold])
    by_density, by_mark = _within(tree, chosen), _within(tree, marked)
    found = sum(c for c, inside in zip(tree.chars, by_density) if inside)
    confirmed = sum(c for c, one, other in zip(tree.chars, by_density, by_mark) if one and other)
    within = by_mark if 2 * confirmed > found else by_density
    parts = [" " if p is None else p[1] for p in tree.pieces if p is None or within[p[0]]]
    return " ".join("".join(parts).split())


def extracted(column: str = "html") -> Column:
    """The main text of a page column."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            yield pa.array([main_text(page) for page in array.to_pylist()], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(F.coalesce(F.col(column).cast("string"), F.lit("")))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with ``text`` and ``n_chars`` instead of their markup."""
    return pages.withColumn("text", extracted(html)).withColumn("n_chars", F.length("text").cast("bigint")).drop(html)


@query("op10_main_text")
def op10_main_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
