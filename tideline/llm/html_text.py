"""Main text of web pages from flat text blocks.

A page is read once into a flat list of text blocks: a block ends wherever a
block-level tag starts or ends.  A decision tree, trained on the small labelled
table below, tells text from the rest by each block's words and share of words in
links, the same of the block before and after it, where it stands (in the page's
article, beside it, or on a page without one) and how strongly names of elements
and classes around it hint that it is not text.  A hint is a feature like the
others: a weak one does not outweigh a long text without links.

A page is handled by itself in mapInArrow: nothing is shuffled and memory is that
of a lot of pages of 2 MB.  Reading is linear: tags cannot match past a ``<``, end tags
of raw elements are found in one scan, and open elements are counted, not searched.

Defined cases: null or empty html has no text (empty string); tags never closed
end with their page, a ``p`` or list item with the next one; repeated rows give
repeated results; a table without rows gives none.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches
from .tokens import lots

_TOKEN = re.compile(r"""<!--|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>|<[!?/][^<>]*>""")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

#: Element names by kind.  What RAW elements hold is never text; UNENDED ones reach to the page's end if never closed.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math canvas object select button".split())
UNENDED = frozenset("script style textarea title xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img label input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav footer aside form menu dialog head".split())
SCOPE = frozenset("article main".split())
#: Elements that a start tag of the name ends, looked for up to the nearest element of the second set.
IMPLIED = {
    "li": (frozenset(["li", "p"]), frozenset("ul ol menu div article section table".split())),
    "dt": (frozenset(["dt", "dd", "p"]), frozenset("dl div article section table".split())),
    "tr": (frozenset(["tr", "td", "th", "p"]), frozenset(["table"])),
    "td": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
IMPLIED |= {"dd": IMPLIED["dt"], "th": IMPLIED["td"]}
#: Words of class, id or role that name what is not main text; COMMENTS hold within an article too.
COMMENTS = frozenset("comment comments reply replies disqus discussion respond".split())
HINTS = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login sidebar side widget widgets nav navbar navigation menu menus breadcrumb "
    "breadcrumbs footer foot copyright contentinfo complementary share sharing social related "
    "recommended recommendations search pagination pager toolbar skip toc".split()
)
HEAD_HINTS = frozenset("header masthead topbar".split())
#: Words that go with a hint in one name without weakening it.
WITH = frozenset("box bar area block section container wrapper list links link item items top bottom left right main text form button buttons policy site page global primary secondary".split())
#: Levels of a hint.
NONE, WEAK, STRONG = 0, 1, 2


@dataclass
class Block:
    text: str
    words: int
    linked: int
    hint: int
    scope: bool


def hint_of(name: str, attrs: str, inside: bool) -> tuple[int, bool]:
    """(level, whether it holds within an article below): by the element's name, then by whole names in class, id and role.

    A name of hint words (and words that go with them) is strong; one that also has other
    words, such as ``search-results-article`` or ``has-sidebar``, is weak.
    """
    if name in ASIDE or (name == "header" and not inside):
        return STRONG, True
    if not attrs.strip() or name in ("html", "body"):
        return NONE, False
    best, lasting = NONE, False
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _HIDDEN.search(value)):
            return STRONG, True
        if key == "role" and value == "banner":
            best = STRONG
        if key in ("class", "id", "role"):
            for token in value.split():
                said = set(re.findall(r"[a-z]+", token))
                hints = said & HINTS or (set() if inside else said & HEAD_HINTS)
                if hints:
                    level = STRONG if said <= HINTS | HEAD_HINTS | WITH else WEAK
                    if level == STRONG and said & COMMENTS:
                        lasting = True
                    best = max(best, level)
    return best, lasting


class _Open:
    """The open elements that matter: (name, hint level, lasting, scope); all questions take constant time."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool, bool]] = []
        self.places: dict[str, list[int]] = {}
        self.bounds: list[int] = []  # of articles and strong parts, which end tags of other elements do not leave
        self.levels: list[tuple[int, int]] = [(NONE, NONE)]  # hint now, and what of it lasts, after each element
        self.scopes = 0

    def push(self, name: str, level: int, lasting: bool, scope: bool) -> None:
        now, kept = self.levels[-1]
        if scope:
            now = kept
        if lasting:
            kept = max(kept, level)
        self.levels.append((max(now, level), kept))
        self.places.setdefault(name, []).append(len(self.stack))
        if scope or level == STRONG:
            self.bounds.append(len(self.stack))
        self.stack.append((name, level, lasting, scope))
        self.scopes += scope

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            name, _, _, scope = self.stack.pop()
            self.places[name].pop()
            self.levels.pop()
            self.scopes -= scope
            if self.bounds and self.bounds[-1] == len(self.stack):
                self.bounds.pop()

    def last(self, names: frozenset[str]) -> int:
        return max((p[-1] for n in names if (p := self.places.get(n))), default=-1)

    def end(self, name: str) -> None:
        at = self.last(frozenset([name]))
        if at >= 0 and at >= (self.bounds[-1] if self.bounds else 0):
            self.cut(at)


_RAW_END = re.compile(r"</(" + "|".join(sorted(RAW)) + r")(?=[\s/>])[^<>]*>", re.I)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    opened = _Open()
    link = -1  # how many elements were open where the link began, -1 outside links
    ends: dict[str, tuple[list[int], list[int]]] | None = None
    at, stop = 0, len(page)

    def close() -> None:
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                linked = sum(len(t.split()) for t, linked in parts if linked)
                out.append(Block(text, len(text.split()), linked, opened.levels[-1][0], opened.scopes > 0))
            parts.clear()

    def say(piece: str) -> None:
        if piece:
            parts.append((html.unescape(piece), link >= 0))

    while at < stop:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = stop if end < 0 else end + 3
            continue
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in RAW:
            if closing:
                continue
            if name not in ("svg", "math", "button"):
                close()
            if ends is None:  # all ends of raw elements, found once
                ends = {}
                for e in _RAW_END.finditer(page):
                    begins, after = ends.setdefault(e[1].lower(), ([], []))
                    begins.append(e.start())
                    after.append(e.end())
            begins, after = ends.get(name, ([], []))
            k = bisect_left(begins, at)
            at = after[k] if k < len(after) else stop if name in UNENDED else at
            continue
        if name == "a":
            link = -1 if closing else len(opened.stack)
            continue
        if name in INLINE:
            if closing:
                if opened.places.get(name):
                    close()
                    opened.end(name)
            elif name not in VOID:
                level, lasting = hint_of(name, m[3], opened.scopes > 0)
                if level == STRONG:
                    close()
                    opened.push(name, level, lasting, False)
            continue
        close()
        if name in VOID:
            continue
        if closing:
            opened.end(name)
        else:
            ended, bound = IMPLIED.get(name, (frozenset(["p"]), frozenset(["table"])))
            first = min((p[-1] for n in ended if (p := opened.places.get(n)) and p[-1] > opened.last(bound)), default=-1)
            if first >= 0 and first >= (opened.bounds[-1] if opened.bounds else 0):
                opened.cut(first)
            opened.push(name, *hint_of(name, m[3], opened.scopes > 0), name in SCOPE)
        if link > len(opened.stack):
            link = -1  # the element that the link stood in has ended
    close()
    return out


#: Columns: words, link share, words before, link share before, words after, link share after, hint (0 none, 1 weak, 2 strong),
#: place (2: in the page's article, 1: the page has none, 0: outside it), text.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "hint", "place")
LABELLED = np.array(
    [
        # Strong hints: menus, adverts, notices, forms, footers and comments, of any length and anywhere.
        (1, 1.0, 1, 1.0, 1, 1.0, 2, 0, 0), (8, 0.0, 1, 1.0, 6, 0.0, 2, 0, 0), (30, 0.0, 60, 0.0, 20, 0.0, 2, 1, 0), (60, 0.05, 40, 0.0, 50, 0.0, 2, 2, 0), (3, 0.3, 70, 0.0, 0, 0.0, 2, 2, 0),
        (80, 0.0, 60, 0.0, 90, 0.0, 2, 1, 0), (22, 0.0, 70, 0.0, 65, 0.0, 2, 0, 0), (4, 0.0, 35, 0.0, 40, 0.0, 2, 2, 0), (55, 0.1, 25, 0.0, 75, 0.0, 2, 1, 0), (9, 0.0, 50, 0.0, 28, 0.0, 2, 1, 0),
        (17, 0.0, 33, 0.0, 45, 0.0, 2, 1, 0), (2, 0.0, 30, 0.0, 80, 0.0, 2, 2, 0), (40, 0.0, 90, 0.0, 35, 0.0, 2, 0, 0), (120, 0.0, 90, 0.0, 60, 0.0, 2, 2, 0), (33, 0.0, 4, 0.0, 70, 0.0, 2, 1, 0),
        (40, 0.0, 30, 0.0, 20, 0.0, 2, 2, 0), (20, 0.0, 50, 0.0, 40, 0.0, 2, 2, 0), (30, 0.0, 2, 0.0, 60, 0.0, 2, 2, 0), (15, 0.1, 80, 0.0, 9, 0.0, 2, 2, 0), (52, 0.0, 12, 0.0, 0, 0.0, 2, 2, 0), (11, 0.0, 25, 0.0, 70, 0.0, 2, 2, 0),
        # Beside the page's article.
        (45, 0.0, 1, 1.0, 6, 0.0, 0, 0, 0), (9, 0.0, 80, 0.0, 0, 0.0, 0, 0, 0), (2, 1.0, 3, 1.0, 2, 1.0, 0, 0, 0), (30, 0.1, 20, 0.0, 9, 0.2, 0, 0, 0), (75, 0.0, 30, 0.0, 60, 0.0, 1, 0, 0),
        (12, 0.0, 65, 0.0, 80, 0.0, 0, 0, 0), (5, 0.0, 60, 0.0, 40, 0.0, 1, 0, 0), (28, 0.0, 40, 0.0, 30, 0.0, 0, 0, 0),
        # In the article: headings, paragraphs, quotations, single links between texts; lists of links are not text.
        (6, 0.0, 0, 0.0, 40, 0.0, 0, 2, 1), (40, 0.0, 6, 0.0, 35, 0.0, 0, 2, 1), (35, 0.1, 40, 0.0, 60, 0.0, 0, 2, 1), (1, 0.0, 35, 0.0, 50, 0.0, 0, 2, 1), (2, 0.0, 1, 0.0, 3, 0.0, 0, 2, 1),
        (90, 0.02, 30, 0.0, 2, 0.0, 0, 2, 1), (3, 1.0, 20, 0.0, 45, 0.0, 0, 2, 1), (12, 0.5, 40, 0.0, 0, 0.0, 0, 2, 1), (5, 0.0, 2, 0.0, 1, 0.0, 0, 2, 1), (3, 0.0, 0, 0.0, 0, 0.0, 0, 2, 1),
        (8, 0.0, 1, 1.0, 4, 0.0, 0, 2, 1), (4, 0.0, 3, 1.0, 2, 1.0, 0, 2, 1), (50, 0.0, 40, 0.0, 45, 0.0, 1, 2, 1), (30, 0.0, 8, 0.0, 25, 0.0, 1, 2, 1), (18, 0.0, 30, 0.0, 20, 0.0, 1, 2, 1),
        (5, 0.0, 40, 0.0, 2, 1.0, 0, 2, 1), (8, 0.0, 30, 0.0, 1, 1.0, 0, 2, 1), (2, 0.0, 20, 0.0, 1, 1.0, 0, 2, 1), (12, 0.0, 50, 0.0, 3, 1.0, 0, 2, 1), (3, 0.0, 1, 1.0, 1, 1.0, 0, 2, 1),
        (5, 1.0, 30, 0.0, 40, 0.0, 0, 2, 1), (2, 1.0, 50, 0.0, 60, 0.0, 0, 2, 1), (8, 0.7, 25, 0.0, 42, 0.0, 0, 2, 1), (1, 0.0, 3, 0.0, 1, 1.0, 0, 2, 1), (10, 0.0, 5, 0.0, 1, 1.0, 0, 2, 1), (6, 0.2, 12, 0.0, 1, 1.0, 0, 2, 1),
        (1, 1.0, 2, 1.0, 1, 1.0, 0, 2, 0), (2, 1.0, 1, 1.0, 3, 1.0, 0, 2, 0), (3, 0.9, 2, 1.0, 2, 1.0, 1, 2, 0), (2, 1.0, 40, 0.0, 1, 1.0, 1, 2, 0), (1, 0.0, 30, 0.0, 2, 1.0, 1, 2, 0),
        # A page without an article: titles and headings are told from labels of menus by the blocks around them.
        (50, 0.0, 8, 0.0, 60, 0.0, 0, 1, 1), (35, 0.1, 50, 0.0, 20, 0.0, 0, 1, 1), (5, 0.0, 3, 1.0, 50, 0.0, 0, 1, 1), (6, 0.0, 45, 0.0, 40, 0.0, 0, 1, 1), (2, 0.0, 40, 0.0, 30, 0.0, 0, 1, 1),
        (18, 0.0, 30, 0.0, 1, 1.0, 0, 1, 1), (12, 0.2, 0, 0.0, 25, 0.0, 0, 1, 1), (3, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1), (25, 0.3, 20, 0.0, 30, 0.0, 0, 1, 1), (80, 0.0, 3, 0.0, 4, 0.0, 1, 1, 1),
        (60, 0.0, 2, 1.0, 45, 0.0, 1, 1, 1), (40, 0.05, 50, 0.0, 1, 1.0, 1, 1, 1), (80, 0.0, 0, 0.0, 0, 0.0, 1, 1, 1), (1, 0.0, 25, 0.0, 35, 0.0, 0, 1, 1), (4, 0.0, 60, 0.0, 50, 0.0, 0, 1, 1),
        (60, 0.0, 1, 1.0, 1, 1.0, 0, 1, 1), (80, 0.0, 1, 0.0, 0, 0.0, 0, 1, 1), (45, 0.0, 1, 0.0, 50, 0.0, 0, 1, 1), (30, 0.0, 1, 1.0, 2, 1.0, 0, 1, 1), (100, 0.0, 1, 0.0, 2, 0.0, 0, 1, 1), (20, 0.0, 1, 1.0, 30, 0.0, 0, 1, 1),
        (8, 0.0, 40, 0.0, 2, 1.0, 0, 1, 1), (5, 0.0, 25, 0.0, 1, 1.0, 0, 1, 1), (11, 0.0, 60, 0.0, 1, 1.0, 0, 1, 1), (10, 0.0, 18, 0.0, 2, 1.0, 0, 1, 1), (7, 0.0, 30, 0.0, 3, 1.0, 0, 1, 1),
        (9, 0.0, 2, 1.0, 12, 0.0, 0, 1, 1), (4, 0.0, 1, 1.0, 20, 0.0, 0, 1, 1), (5, 0.0, 1, 1.0, 2, 0.0, 0, 1, 0), (4, 0.0, 2, 1.0, 3, 0.0, 0, 1, 0),
        (1, 1.0, 2, 1.0, 1, 1.0, 0, 1, 0), (3, 1.0, 0, 0.0, 2, 1.0, 0, 1, 0), (4, 0.8, 2, 1.0, 30, 0.0, 0, 1, 0), (8, 0.9, 50, 0.0, 3, 1.0, 0, 1, 0), (20, 0.8, 3, 1.0, 2, 1.0, 0, 1, 0),
        (2, 0.0, 1, 1.0, 1, 1.0, 0, 1, 0), (3, 0.0, 2, 1.0, 2, 1.0, 0, 1, 0), (1, 0.0, 3, 1.0, 1, 1.0, 0, 1, 0), (4, 0.0, 1, 1.0, 2, 1.0, 0, 1, 0), (2, 0.0, 0, 0.0, 1, 1.0, 0, 1, 0),
        (3, 1.0, 0, 0.0, 80, 0.0, 0, 1, 0), (2, 1.0, 1, 1.0, 60, 0.0, 0, 1, 0), (4, 1.0, 2, 1.0, 45, 0.0, 0, 1, 0), (3, 0.9, 35, 0.0, 50, 0.0, 0, 1, 0), (6, 1.0, 0, 0.0, 40, 0.0, 0, 1, 0),
        (7, 1.0, 1, 1.0, 0, 0.0, 0, 1, 0), (5, 0.6, 60, 0.0, 4, 1.0, 0, 1, 0), (2, 0.7, 40, 0.0, 0, 0.0, 0, 1, 0), (3, 0.0, 1, 1.0, 0, 0.0, 0, 1, 0), (6, 0.0, 2, 1.0, 1, 1.0, 0, 1, 0),
        (3, 0.0, 20, 0.0, 2, 0.0, 1, 1, 0), (5, 0.0, 60, 0.0, 40, 0.0, 1, 1, 0), (2, 0.5, 3, 0.0, 2, 0.0, 1, 1, 0), (6, 0.0, 4, 0.0, 30, 0.0, 1, 1, 0), (4, 0.0, 0, 0.0, 0, 0.0, 1, 1, 0),
    ],
    float,
)


@dataclass
class Tree:
    """A node of a binary decision tree: feature and cut, or a leaf's share of text blocks."""

    share: float
    feature: int = -1
    cut: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.low is None or self.high is None:
            return np.full(len(x), self.share)
        left = x[:, self.feature] <= self.cut
        out = np.empty(len(x))
        out[left], out[~left] = self.low.predict(x[left]), self.high.predict(x[~left])
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1) -> Tree:
    """A tree by greatest fall of Gini impurity; equal falls take the earlier feature and the lower cut."""
    node = Tree(float(y.mean()))
    if depth == 0 or node.share in (0.0, 1.0):
        return node
    best = (1e-9, -1, 0.0)
    gini = lambda v: 2 * len(v) * v.mean() * (1 - v.mean()) if len(v) else 0.0
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= cut
            if least <= left.sum() <= len(y) - least:
                fall = gini(y) - gini(y[left]) - gini(y[~left])
                if fall > best[0] + 1e-12:
                    best = (fall, f, float(cut))
    if best[1] < 0:
        return node
    left = x[:, best[1]] <= best[2]
    node.feature, node.cut = best[1], best[2]
    node.low, node.high = grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least)
    return node


@cache
def trained() -> Tree:
    return grow(LABELLED[:, :-1], LABELLED[:, -1])


def features(found: list[Block]) -> np.ndarray:
    n = len(found)
    words = np.array([b.words for b in found], float)
    links = np.array([min(1.0, b.linked / b.words) for b in found])
    pad = lambda v: np.concatenate([[0.0], v, [0.0]])
    scoped = any(b.scope for b in found)
    place = [2.0 if b.scope else 0.0 if scoped else 1.0 for b in found]
    return np.column_stack([words, links, pad(words)[:n], pad(links)[:n], pad(words)[2:], pad(links)[2:], [float(b.hint) for b in found], place])


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    keep = trained().predict(features(found)) >= 0.5
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """Adds ``out``, the main text, and n_chars, its code points."""
    from pyspark.sql import types as T

    slim = pages.drop(out, "n_chars") if page not in (out, "n_chars") else pages
    names = slim.columns
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lots(batches, names.index(page), rows=256):
            texts = [main_text(p) for p in b.column(names.index(page)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, out, "n_chars"])

    return slim.mapInArrow(run, T.StructType([*slim.schema.fields, T.StructField(out, T.StringType()), T.StructField("n_chars", T.LongType())]))


def op9_html_text(pages: DataFrame) -> DataFrame:
    """The contract's columns, from extract over the whole table."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
