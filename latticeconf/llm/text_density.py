"""Main text of HTML pages by composite text density.

Every DOM node gets its characters per tag, adjusted for the share of link text
(composite text density); a node's density sum adds its children's densities.
The node of the greatest sum is the main content's root; the least density on
its path from the body is the threshold above which other subtrees count as
content too; a leaf's sum is its own density, and a leaf beside the content (or
beside a node around it) counts from HALF the mean of the content's blocks, an h1
at any density. Nodes whose tag or role says menu, footer, advert and so on are
taken out before densities are computed, as are scripts, styles, forms and
comments. A class or id can do so where its whole name says it ("comments",
"site-footer"); one that merely holds such a word ("social-science", an id made from
a heading) proposes, and link-adjusted density decides: the node goes if at least HALF of
its text is links. Ids of sections, paragraphs, quotes, figures and rows only
propose, since they are often made from headings, and headings are never marked.
No class or id, and no form, takes out what holds main or else the longest article,
or on a page without either MOST of the text.

Pages are parsed one per row (mapInArrow, no shuffle), with explicit stacks, so
deep nesting costs no recursion. Defined cases: null, empty or text-free html
gives the empty text; unclosed tags are closed by their context; of equal sums
the first node in page order wins; repeated rows repeat; extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("head script style noscript template nav aside footer button select textarea input iframe object embed svg canvas audio video dialog menu title".split())
#: What may stand in a head; anything else ends it.
IN_HEAD = frozenset("base basefont bgsound head link meta noscript object script style template title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Parts of class and id names that mark what isn't the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer header masthead topbar cookie cookies consent notice notices alert popup modal newsletter subscribe signup login share sharing social related recommended comment comments commentlist respond reply replies disqus widget toolbar pagination pager".split()
)
#: Parts that leave a name's meaning to its marks, and parts that turn it round.
NEUTRAL = frozenset("site main page post posts entry article articles story stories content left right top bottom primary secondary global container wrapper wrap box area list section block bar links link buttons button inner outer item items group row col column panel module slot zone region fixed sticky body text title".split())
TURNED = frozenset("no not non has have with without free hide hidden before after".split())
#: Tags whose ids are often made from headings.
TEXTUAL = frozenset("section p blockquote figure figcaption li dt dd tr td th pre table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Share of the page's text that no class or id can take out.
MOST = 0.75
#: A leaf beside the content belongs to it from this share of the content's mean density; a node that holds a mark goes from this share of links.
HALF = 0.5
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
_P_STAYS_IN = frozenset("article aside body button caption div td th table section main li object html".split())
_SPACE = re.compile(r"\s+")
_SPLIT = re.compile(r"[^a-z0-9]+")


class _Tree(HTMLParser):
    """Nodes in page order as parallel lists: tag, parent, and pieces of text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.drop, self.mark = ["#page"], [-1], [False], [0]
        self.pieces: list[tuple[int, str | None]] = []  # (node, text); None: a block's edge
        self.open, self.live = [0], Counter()  # tags that are open, to pass over what can't be closed

    def _close(self, k: int) -> None:
        self.live.subtract(self.tag[i] for i in self.open[k:])
        del self.open[k:]

    def _pop_to(self, tags, scope) -> None:
        if not any(self.live[tag] for tag in tags):
            return
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[k]]
            if tag in tags:
                self._close(k)
                self.pieces.append((self.open[-1], None))
                return
            if tag in scope:
                return

    def handle_starttag(self, tag, attrs):
        if self.live["head"] and tag not in IN_HEAD:
            self._pop_to(("head",), ())  # </head> may be left out
        if tag in BLOCK:
            self._pop_to(("p",), _P_STAYS_IN)
            self.pieces.append((self.open[-1], None))
        if tag in CLOSES:
            for _ in CLOSES[tag]:
                self._pop_to(CLOSES[tag], SCOPE[tag])
        up = self.open[-1]
        inside = self.live["article"] > 0 or self.live["main"] > 0
        self.tag.append(tag)
        self.parent.append(up)
        self.drop.append(self.drop[up] or tag in DROPPED or tag == "header" and not inside or _hidden(tag, attrs))
        self.mark.append(_marked(tag, attrs, inside))
        if tag in VOID:
            self.pieces.append((up, " "))
        else:
            self.open.append(len(self.tag) - 1)
            self.live[tag] += 1

    def handle_endtag(self, tag):
        if not self.live[tag]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[k]] == tag:
                if tag in BLOCK:
                    self.pieces.append((self.open[k], None))
                self._close(k)
                return
            if tag not in BLOCK and self.tag[self.open[k]] in BLOCK:
                return  # a stray inline end tag doesn't close a block

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def handle_data(self, data):
        self.pieces.append((self.open[-1], data))


def _hidden(tag: str, attrs) -> bool:
    if tag in ("html", "body", "article", "main"):
        return False
    return any(k == "role" and (v or "").lower() in ROLES or k == "hidden" or k == "aria-hidden" and (v or "").lower() == "true" for k, v in attrs)


def _strength(name: str, inside: bool) -> int:
    """What a class or id says against its node: 0 nothing, 1 it holds such a word, 2 all of it does; inside an article a header is its own."""
    parts = {x for x in _SPLIT.split(name.lower()) if x}
    marks = parts & MARKS - ({"header"} if inside else set())
    if not marks or parts & TURNED:
        return 0
    return 2 if all(x in MARKS or x in NEUTRAL or x.isdigit() for x in parts) else 1


def _marked(tag: str, attrs, inside: bool) -> int:
    """The strongest mark of the node's classes and id."""
    if tag in HEADINGS or tag in ("html", "body", "article", "main"):
        return 0
    if tag == "form":  # a page may be wrapped in one
        return 2
    found = [0]
    for k, v in attrs:
        if k == "class":
            found += [_strength(x, inside) for x in (v or "").split()]
        elif k == "id":
            found.append(min(_strength(v or "", inside), 1 if tag in TEXTUAL else 2))
    return max(found)


def drop_marked(tree: _Tree) -> None:
    """Drops marked nodes, but for those that hold main or else the longest article, or on a page without them most of the text."""
    n = len(tree.tag)
    chars, link_chars, in_link = [0] * n, [0] * n, [False] * n
    for i in range(1, n):
        in_link[i] = tree.tag[i] == "a" or in_link[tree.parent[i]]
    for i, s in tree.pieces:
        if s and not tree.drop[i]:
            chars[i] += (size := len(_SPACE.sub("", s)))
            link_chars[i] += size * in_link[i]
    for i in range(n - 1, 0, -1):
        if not tree.drop[i]:
            chars[tree.parent[i]] += chars[i]
            link_chars[tree.parent[i]] += link_chars[i]
    live = [i for i in range(n) if chars[i] and not tree.drop[i]]
    held = [i for i in live if tree.tag[i] == "main"] or sorted((i for i in live if tree.tag[i] == "article"), key=lambda i: (-chars[i], i))[:1]
    most = math.inf if held else MOST * chars[0]
    kept = set()
    for i in held:
        while i > 0 and i not in kept:
            kept.add(i)
            i = tree.parent[i]
    for i in range(1, n):
        said = tree.mark[i] == 2 or tree.mark[i] == 1 and link_chars[i] >= HALF * chars[i]
        aside = said and i not in kept and chars[i] < most
        tree.drop[i] = tree.drop[i] or tree.drop[tree.parent[i]] or aside


def densities(tree: _Tree) -> tuple[list[float], list[float], list[int]]:
    """Composite text density and density sum of every node, and its characters.

    Inline formatting doesn't break up text, so only links and blocks count as
    tags; text of other inline nodes counts for the block that holds it.
    """
    n = len(tree.tag)
    counts = [t == "a" or t in BLOCK or k == 0 for k, t in enumerate(tree.tag)]
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = tree.tag[i] == "a" or in_link[tree.parent[i]]
    for i, s in tree.pieces:
        if s and not tree.drop[i] and (size := len(_SPACE.sub("", s))):
            chars[i] += size
            if in_link[i]:
                link_chars[i] += size
    for i in range(n - 1, 0, -1):
        up = tree.parent[i]
        if not tree.drop[i]:
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
            tags[up] += tags[i] + counts[i]
            link_tags[up] += link_tags[i] + (tree.tag[i] == "a")
    share = link_chars[0] / max(1, chars[0])
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        c, lc, t = chars[i], link_chars[i], max(1, tags[i])
        if c and not tree.drop[i]:
            # log_b(x): the base b grows with the links of the node and the page
            b = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            x = c / max(1, lc) * t / max(1, link_tags[i])
            density[i] = c / t * math.log(max(1.0, x)) / (1.0 + math.log(b))
        if counts[i] and not total[i]:
            total[i] = density[i]  # a leaf's sum is its own density
        if i:
            if counts[i]:
                total[tree.parent[i]] += density[i]
            else:  # an inline node passes on what it holds
                total[tree.parent[i]] += total[i]
    return density, total, chars


def main_nodes(tree: _Tree) -> set[int]:
    """Nodes whose whole subtree, without dropped parts, is content."""
    density, total, chars = densities(tree)
    n = len(tree.tag)
    below: list[list[int]] = [[] for _ in range(n)]
    most = list(total)
    for i in range(n - 1, 0, -1):
        below[tree.parent[i]].append(i)
        most[tree.parent[i]] = max(most[tree.parent[i]], most[i])
    body = next((i for i in range(n) if tree.tag[i] == "body" and chars[i]), 0)
    if not chars[body]:
        return set()
    best, stack = body, [body]
    while stack:
        i = stack.pop()
        if (total[i], -i) > (total[best], -best):
            best = i
        stack += [k for k in below[i] if chars[k] and not tree.drop[k]]
    threshold, i = density[best], best
    while i != body:
        i = tree.parent[i]
        threshold = min(threshold, density[i])
    i = best
    while i != body and tree.tag[i] not in ("article", "main"):
        i = tree.parent[i]
    if tree.tag[i] in ("article", "main"):
        best = i  # the content root is lifted to the article that it lies in
    chosen, stack = {best}, [body]
    beside = HALF * total[best] / max(1, sum(density[k] > 0 for k in below[best]))
    i = body if tree.tag[best] in ("article", "main") else best
    while i != body:  # short blocks beside the content: its title, and leaves nearly as dense as its own
        i = tree.parent[i]
        leaves = [k for k in below[i] if tree.tag[k] in BLOCK and total[k] == density[k] and chars[k] and not tree.drop[k]]
        chosen.update(k for k in leaves if tree.tag[k] == "h1" or density[k] >= beside)
    while stack:
        i = stack.pop()
        if i in chosen or density[i] < threshold:
            continue
        live = [k for k in below[i] if chars[k] and not tree.drop[k]]
        if total[i] and total[i] >= most[i]:
            chosen.add(i)
        else:
            stack += live
    return chosen


def extract(html: str | None) -> str:
    """The main text: blocks in page order, one a line."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    drop_marked(tree)
    chosen = main_nodes(tree)
    inside = [False] * len(tree.tag)
    for i in range(len(tree.tag)):
        inside[i] = not tree.drop[i] and (i in chosen or i > 0 and inside[tree.parent[i]])
    blocks, parts = [], []
    for i, s in [*tree.pieces, (0, None)]:
        if s is None:
            if block := _SPACE.sub(" ", "".join(parts)).strip():
                blocks.append(block)
            parts = []
        elif inside[i]:
            parts.append(s)
    return "\n".join(blocks)


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract_batches(batches):
    for batch in batches:
        texts = [extract(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=_SCHEMA)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_extract_batches, "page_id long, url string, text string, n_chars long")
