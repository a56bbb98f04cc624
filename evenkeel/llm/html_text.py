"""Main text of web pages by composite text density.

The page is read into a tree. For every node, C characters and T tags of its
subtree and the LC characters and LT tags of its links give its density

    C / T * log(C / LC * T / LT) to the base ln(C / (C - LC) * LC + LC_b / C_b * C + e^2)

(b: the body; 0 is read as 1; e^2 keeps the base at 2 or more). The node whose
children's densities have the largest sum is the heart of the article; the least
density on its path to the body is the threshold. The article is the heart and every
other subtree beside the path whose density reaches the threshold.

Tags and names raise or lower what a subtree needs. Where ``article`` or ``main`` stands
around the heart, the outermost ``article`` (without one, ``main``) belongs to it as a whole, but for
blocks below the threshold that are links by more than half; an ``article`` beside it needs
a third of the threshold, other blocks beside it the threshold and a common ``main``.

Elements that are never article text (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments) are left out before anything is
counted: by their tag or role, or by a class or id of nothing but words for such
things and for places ("cookie-bar"). A word of several senses ("discussion", "notice"), or one
among other words ("cookie-recipes"), only lowers the block's standing: it does not count
for the blocks around it, and stays if it has half the threshold and a tenth of the heart's
characters. Words of several senses among other words ("social-history") mean nothing. An element
around an article keeps its place whatever its class.

Character references are decoded, white space inside a block becomes one space,
blocks stand in page order with an empty line between them. NULL and empty pages,
and pages of nothing but such elements, have an empty text. Broken markup never
fails: unclosed elements end with their parents, stray end tags are ignored. Time and
memory grow with the length of a page, whatever its depth; a page has to fit in a task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from evenkeel.llm.common import bounded_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary
    table tbody tfoot thead caption tr ul""".split()
)
NEVER = frozenset(
    """head title script style noscript template svg math canvas iframe object audio video nav footer aside form
    button select option textarea input label dialog menu search""".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Words of class and id that name what is not the article, ...
NAMES = frozenset(
    """nav navbar navigation menu menubar submenu breadcrumb breadcrumbs masthead topbar banner footer
    bottombar colophon sidebar sidebars widget widgets ad ads adv advert adverts advertisement
    advertising adsense adslot sponsor sponsored promo promoted cookie cookies consent gdpr
    popup modal overlay lightbox comment comments commentlist disqus newsletter subscribe
    subscription signup login searchbox pagination pager toolbar hidden""".split()
)
# ... that may also name a part of it, ...
UNSURE = frozenset(
    """header aside rail promotion notice notices notification alert disclaimer replies reply respond discussion
    social share sharing follow related recommended recommendations register skip""".split()
)
# ... and that say nothing of what stands there.
PLACES = frozenset(
    """area article articles bar block box buttons button container content first fixed form global group header icons
    inner item items large last left link links list main outer page panel post posts primary reader right row
    secondary section site slot small sticky story stories thread top bottom unit us user wrap wrapper""".split()
)
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond discussion ad ads advert".split())
# A class that starts so says what stands beside the element.
BESIDE = frozenset(("has", "with", "no", "without"))
CONTAINERS = frozenset(("article", "main"))
# What an element's start ends, looked for among the open elements up to the first of the second set.
IMPLIED = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "option": (frozenset(("option",)), frozenset(("select",))),
}
_P_SCOPE = frozenset("td th table button html body article section div main aside nav footer header".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+").findall
_MARKED = re.compile(r"<!\[[^>]*>?")
_OPENS = re.compile(r"<[A-Za-z/!?]").search


def standing(token: str, about: frozenset) -> int:
    """What a class or id says of an element: 2 not the article, 1 perhaps not, 0 nothing."""
    words = [w.lower() for w in _NAME(token)]
    if not words or words[0] in BESIDE:
        return 0
    sure, unsure = not (about & NAMES).isdisjoint(words), not (about & UNSURE).isdisjoint(words)
    alone = all(w in NAMES or w in UNSURE or w in PLACES for w in words)
    return (2 if alone else 1) if sure else int(unsure and alone)


_ANY = NAMES | UNSURE


class Tree(HTMLParser):
    """Nodes in page order with their parents, and the page as a run of texts and block breaks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents = ["#page"], [0]
        self.never, self.named = [False], [0]
        self.open = [0]
        self.run: list[tuple[int, str | None]] = []

    def _close_to(self, wanted: frozenset, stop: frozenset) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.tags[self.open[k]]
            if tag in wanted:
                self._pop(k)
                return
            if tag in stop:
                return

    def _pop(self, k: int) -> None:
        for node in reversed(self.open[k:]):
            if self.tags[node] in BLOCKS:
                self.run.append((node, None))
        del self.open[k:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._close_to(frozenset(("p",)), _P_SCOPE)
        if tag in IMPLIED:
            self._close_to(*IMPLIED[tag])
        node = len(self.tags)
        self.tags.append(tag)
        self.parents.append(self.open[-1])
        never, named = tag in NEVER, 0
        for name, value in attrs:
            value = value or ""
            if name in ("class", "id"):
                for token in value.split() if tag not in ("html", "body", "main") else ():
                    named = max(named, standing(token, COMMENTS if tag == "article" else _ANY))
            elif name == "role":
                named = 2 if value.strip().lower() in ROLES else named
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                named = 2
            elif name == "style" and "display:none" in value.replace(" ", "").lower():
                named = 2
        self.never.append(never)
        self.named.append(named)
        if tag in BLOCKS:
            self.run.append((node, None))
        elif tag in ("br", "td", "th"):
            self.run.append((node, " "))
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            at = self.tags[self.open[k]]
            if at == tag:
                self._pop(k)
                return
            if at in BLOCKS and tag not in BLOCKS:
                return

    def handle_data(self, data):
        self.run.append((self.open[-1], data))


def read_page(html: str) -> Tree:
    # a tag that is cut off at the end of the page
    if cut := _OPENS(html, html.rfind(">") + 1):
        html = html[: cut.start()]
    tree = Tree()
    try:
        tree.feed(html)
        tree.close()
    except AssertionError:  # a marked section of a kind the parser does not know
        tree = Tree()
        tree.feed(_MARKED.sub("", html))
        tree.close()
    return tree


def density(c: int, t: int, lc: int, lt: int, body_c: int, body_lc: int) -> float:
    if not c:
        return 0.0
    inner = c / max(c - lc, 1) * lc + body_lc / max(body_c, 1) * c + math.e**2
    ratio = c / max(lc, 1) * max(t, 1) / max(lt, 1)
    return c / max(t, 1) * math.log(max(ratio, 1.0)) / math.log(inner) if ratio > 1 else 0.0


class Page:
    """A tree with what is left out, and the characters, tags and densities of every node.

    ``low`` nodes have numbers of their own, but do not count for their parents.
    """

    def __init__(self, tree: Tree, unsure: bool = True):
        self.tree = tree
        tags, parents = tree.tags, tree.parents
        n = len(tags)
        # what holds a container that is not itself left out is not left out by name
        holds = self.holds = [t in CONTAINERS and not named for t, named in zip(tags, tree.named)]
        for i in range(n - 1, 0, -1):
            if holds[i] and not tree.never[i]:
                holds[parents[i]] = True
        out, low, beneath = [False] * n, [False] * n, [False] * n
        in_container = [t in CONTAINERS for t in tags]
        for i in range(1, n):
            p = parents[i]
            in_container[i] |= in_container[p]
            page_header = tags[i] == "header" and not in_container[p] and not holds[i]
            named = 0 if holds[i] and tags[i] != "article" else tree.named[i]
            out[i] = out[p] or tree.never[i] or page_header or named == 2
            low[i] = unsure and named == 1 and not out[i]
            beneath[i] = beneath[p] or low[i]
        c, t, lc, lt = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [tag == "a" for tag in tags]
        for i in range(1, n):
            in_link[i] |= in_link[parents[i]]
        for i, data in tree.run:
            if data and not out[i]:
                size = len(data) - data.count(" ")
                c[i] += size
                if in_link[i]:
                    lc[i] += size
        for i in range(n - 1, 0, -1):
            p = parents[i]
            if not out[i] and not low[i]:
                c[p] += c[i]
                t[p] += t[i] + 1
                lc[p] += lc[i]
                lt[p] += lt[i] + (tags[i] == "a")
        self.out, self.low, self.c, self.t, self.lc, self.lt = out, low, c, t, lc, lt
        body = next((i for i in range(n) if tags[i] == "body"), 0)
        self.body = body = body if c[body] else 0
        d = self.d = [0.0 if out[i] else density(c[i], t[i], lc[i], lt[i], c[body], lc[body]) for i in range(n)]
        sums = self.sums = [0.0] * n
        for i in range(1, n):
            if not low[i]:
                sums[parents[i]] += d[i]
        fit = [c[i] > 0 and not out[i] and not beneath[i] for i in range(n)]
        self.heart = max(range(body, n), key=lambda i: (fit[i], sums[i], -i))
        self.empty = not fit[self.heart]
        self.path = [self.heart]
        while self.path[-1] not in (body, 0):
            self.path.append(parents[self.path[-1]])
        self.threshold = min((d[i] for i in self.path if c[i]), default=0.0)

    def article(self) -> list[bool]:
        """Whether a node is of the article."""
        tags, parents, c, d, threshold = self.tree.tags, self.tree.parents, self.c, self.d, self.threshold
        n = len(tags)
        inside, path = [False] * n, set(self.path)
        around = [i for i in self.path if tags[i] in CONTAINERS]
        base = next((i for i in reversed(around) if tags[i] == "article"), around[0] if around else None)
        if base is None and not self.holds[self.heart]:
            inside[self.heart] = True
            for i in range(self.body + 1, n):
                if parents[i] in path and i not in path and not self.low[i] and c[i] and d[i] >= threshold:
                    inside[i] = True
            # bare text beside the heart belongs to no child
            for i, data in self.tree.run:
                if data and i in path and i != self.heart and tags[i] not in ("body", "html", "#page") and data.strip():
                    inside[i] = True
        else:
            if base is not None:
                inside[base] = True
            # containers beside the heart's, or those it holds, and dense blocks in a common main
            above = set(self.path[self.path.index(base) + 1 :]) if base is not None else {self.heart}
            in_main, free = [False] * n, [False] * n
            for i in range(n):
                p = parents[i]
                in_main[i] = tags[i] == "main" or (i > 0 and in_main[p])
                free[i] = i in above or (i > 0 and free[p] and self.holds[i] and tags[i] not in CONTAINERS)
                if i == 0 or i in path or not free[p] or self.low[i] or not c[i]:
                    continue
                if tags[i] in CONTAINERS:
                    inside[i] = 3 * d[i] >= threshold
                elif not self.holds[i]:
                    inside[i] = in_main[p] and base is not None and d[i] >= threshold
            if not any(inside):
                tops = [i for i in range(n) if tags[i] in CONTAINERS and not self.out[i]]
                inside[max(tops, key=lambda i: (c[i], -i))] = True
        for i in range(1, n):
            if inside[parents[i]] and not inside[i] and (i in path or not self._apart(i)):
                inside[i] = True
        return inside

    def _apart(self, i: int) -> bool:
        """Whether a node inside the article is none of it."""
        if self.low[i]:
            return 2 * self.d[i] < self.threshold or 10 * self.c[i] < self.c[self.heart]
        links = self.tree.tags[i] in BLOCKS and self.lt[i] > 2 and 2 * self.lc[i] > self.c[i]
        return links and self.d[i] < self.threshold


def main_text(html: str) -> str:
    """The article of a page, its blocks parted by empty lines."""
    if not html:
        return ""
    tree = read_page(html)
    page = Page(tree)
    if page.empty and any(page.low):
        page = Page(tree, unsure=False)
    if page.empty:
        return ""
    inside, out = page.article(), page.out
    blocks, block = [], []
    for i, data in [*tree.run, (0, None)]:
        if data is None:
            if block:
                text = " ".join("".join(block).split())
                if text:
                    blocks.append(text)
                block = []
        elif inside[i] and not out[i]:
            block.append(data)
    return "\n\n".join(blocks)


def article_text(html: Column) -> Column:
    """Main text of a column of pages."""
    bounded_batches()

    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(v.as_py() or "") for v in batch], pa.string())

    return extract(html)
