"""Main text of web pages: flat text blocks, judged by a decision tree over their own and their neighbours' shape.

A page is cut at block-level tags.  Each block has its number of words and its link density (share of its characters
inside links), those of the block before and after, and three marks: inside a container whose tag, class, id or role
names boilerplate; inside one that names content; a heading.  A name counts as a whole: words of state (has-sidebar,
comment-enabled) name nothing, and an element that names content as well isn't boilerplate.  A form or a named container
around the page's article isn't either.  A small tree is trained on PAGES, labelled blocks of pages of many shapes.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from driftwood.llm.common import table, tune

#: Text of these is never shown.
SKIPPED = frozenset("script style noscript template textarea select option svg math iframe object canvas title button datalist audio video".split())
#: Of these, those that go on to the end of the page if they are never closed, and that a slash doesn't close.
RAW = frozenset("script style".split())
#: Of these, those that may be within one of their own.
NESTED = frozenset("svg math object template noscript".split())
CONTAINERS = frozenset("html body head nav header footer aside form article main section div ul ol dl table tbody thead tr td th blockquote figure details fieldset dialog menu search address".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr figcaption caption legend summary center optgroup".split())
BOILER_TAGS = frozenset("head nav header footer aside form menu dialog search".split())
CONTENT_TAGS = frozenset("article main".split())
#: Boilerplate of these kinds is so whatever it holds.
FIRM = frozenset("head nav header footer aside menu search".split())
#: What a form or dialog around a whole page holds.
PAGE_PARTS = frozenset("article main h1 nav header footer".split())
BOILER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs "
    "header masthead topbar footer foot bottombar sidebar aside rail widget widgets related recommended recommendations trending popular comment comments reply replies respond discussion disqus "
    "cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login register share sharing social follow search form "
    "pagination pager skip copyright legal disclaimer hidden".split()
)
CONTENT_NAMES = frozenset("article content post entry story main body text".split())
#: Words of a name that tell a state; such a name says nothing of what the element holds.
STATE_NAMES = frozenset("has is with without no not enabled disabled open closed active inactive on off below above".split())

#: A tag without "<" before its end, and its beginning; what else a page holds.
TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^<>'"]+|"[^"<]*"|'[^'<]*')*+)>""")
OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
OTHER = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>?|[^<]+|<", re.S)
CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in SKIPPED}
OPENING = {name: re.compile(rf"<{name}(?=[\s/>])", re.I) for name in SKIPPED - RAW}
#: Tags that no skipped element has inside; a closing tag behind them belongs to another element.
BARRIER = re.compile(r"<(?:/?(?:article|main|body|nav|footer|header|aside)|h1)(?=[\s/>])", re.I)
BARRIERS = dict.fromkeys(("button", "option", "title"), re.compile(r"<(?:/?(?:article|main|body|nav|footer|header|aside|section|p|ul|ol|table)|h[1-6])(?=[\s/>])", re.I))
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
UNSEEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*["']?true""", re.I)


def _unquoted(attributes: str) -> bool:
    """Whether they end with a value without quotes; a slash behind it belongs to it and doesn't close the element."""
    last = re.split(r"[\s\"']", attributes)[-1]
    return "=" in last[:-1] or bool(last) and attributes[: len(attributes) - len(last)].rstrip().endswith("=")


class _Tags:
    """Finds tags: linear in the page, whatever is open or broken in it.

    A tag ends at the first ">" outside quotes; a quote that nothing closes is a character like others.  Where a search finds no
    end, it marks the quotes that it met outside of strings, and later searches that meet one of them end there.
    """

    def __init__(self, page: str):
        self.page, self.last, self.special, self.dead = page, page.rfind(">"), None, set()

    def _next(self, kind: str, at: int) -> int:
        found = self.special[kind]
        k = bisect_left(found, at)
        return found[k] if k < len(found) else -1

    def end(self, at: int) -> int:
        """Where the tag ends whose name ends before at; -1 if it doesn't."""
        if at > self.last:
            return -1
        if self.special is None:
            self.special = {kind: [m.start() for m in re.finditer(kind, self.page)] for kind in ('"', "'", ">", "['\">]")}
        met = []
        while (at := self._next("['\">]", at)) >= 0 and at not in self.dead:
            kind = self.page[at]
            if kind == ">":
                return at
            met.append(at)
            at = max(at, self._next(kind, at + 1)) + 1
        self.dead.update(met)
        return -1

    def match(self, at: int) -> tuple[str, str, str, bool, int] | None:
        """(slash, name, attributes, whether a slash closes it, end) of the tag at a position."""
        found = TAG.match(self.page, at)
        if found:
            slash, name, attributes, stop = found[1], found[2], found[3], found.end()
        else:
            found = OPEN.match(self.page, at)
            stop = self.end(found.end()) + 1 if found else 0
            if not stop:
                return None
            slash, name, attributes = found[1], found[2], self.page[found.end() : stop - 1]
        closed = attributes.endswith("/")
        return slash, name.lower(), attributes[:-1] if closed else attributes, closed, stop


class Block(NamedTuple):
    text: str
    words: int
    links: float
    boiler: int
    content: int
    heading: int


def _marks(tag: str, attributes: str) -> tuple[int, int, bool]:
    """Whether an element names boilerplate, whether content, and whether it is boilerplate whatever it holds."""
    boiler, content, unseen = False, False, False
    if attributes and tag not in ("html", "body"):
        if "=" in attributes:
            for found in NAMED.finditer(attributes):
                for name in (found[1] or found[2] or found[3] or "").lower().split():
                    words = set(re.split(r"[^a-z0-9]+", name))
                    if not words & STATE_NAMES:
                        bad = bool(words & BOILER_NAMES)
                        boiler |= bad
                        content |= not bad and bool(words & CONTENT_NAMES)
        unseen = bool(UNSEEN.search(attributes))
    boiler &= not content
    content |= tag in CONTENT_TAGS and not boiler
    return int(boiler or unseen or tag in BOILER_TAGS), int(content), unseen or tag in FIRM


class _Page:
    """The open containers of a page, and what is known of each: linear in the page, however deep it is nested."""

    def __init__(self):
        self.parent, self.boiler, self.content, self.firm, self.form, self.around, self.main = [-1], [0], [0], [True], [False], [False], [0]
        self.names, self.open, self.at, self.articles = [""], Counter(), 0, 0

    def enter(self, name: str, marks: tuple[int, int, bool]) -> None:
        self.parent.append(self.at)
        self.names.append(name)
        for column, x in ((self.boiler, marks[0]), (self.content, marks[1]), (self.firm, marks[2]), (self.form, name in ("form", "dialog")), (self.around, False), (self.main, 0)):
            column.append(x)
        if marks[1] and name in CONTENT_TAGS:
            self.articles += name == "article"
            up = self.at  # what is around an article, up to what is known already
            while up > 0 and self.main[up] < (2 if name == "main" else 1):
                self.main[up] = 2 if name == "main" else 1
                up = self.parent[up]
        self.at = len(self.parent) - 1
        self.open[name] += 1

    def part(self) -> None:
        up = self.at
        while up > 0 and not self.around[up]:
            self.around[up] = True
            up = self.parent[up]

    def leave(self, name: str) -> None:
        while self.open[name]:
            last = self.names[self.at]
            self.open[last] -= 1
            self.at = self.parent[self.at]
            if last == name:
                return

    def marks(self) -> tuple[list[int], list[int]]:
        """Boilerplate and content, for each container with those around it."""
        boiler, content = [0] * len(self.parent), [0] * len(self.parent)
        for k in range(1, len(self.parent)):
            around = self.form[k] and self.around[k] or self.main[k] == 2 or (self.main[k] == 1 and self.articles == 1)
            up = self.parent[k]
            boiler[k] = int(boiler[up] or (self.boiler[k] and (self.firm[k] or not around)))
            content[k] = int(content[up] or self.content[k])
        return boiler, content


def blocks(page: str) -> list[Block]:
    """The non-empty blocks of a page, in page order."""
    found: list[tuple[str, int, float, int, tuple[int, int], int]] = []
    containers = _Page()
    pieces: list[str] = []
    linked: list[str] = []
    own, heading, in_link = (0, 0), 0, 0

    def end():
        nonlocal own, heading
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            inside = sum(map(len, " ".join(html.unescape("".join(linked)).split())))
            found.append((text, text.count(" ") + 1, min(1.0, inside / len(text)), containers.at, own, heading))
        pieces.clear()
        linked.clear()
        own, heading = (0, 0), 0

    ahead: dict = {}

    def following(pattern: re.Pattern) -> int:
        """Where the next match begins; it is looked for once, however often it is asked for."""
        if ahead.get(pattern, -1) < at:
            match = pattern.search(page, at)
            ahead[pattern] = match.start() if match else len(page) + 1
        return ahead[pattern]

    at, tags = 0, _Tags(page)
    while at < len(page):
        tag = tags.match(at) if page[at] == "<" else None
        if tag is None:
            token = OTHER.match(page, at)
            raw, at = token[0], token.end()
            if raw[0] != "<" or raw == "<":
                pieces.append(raw)
                if in_link:
                    linked.append(raw)
            continue
        slash, name, attributes, closed, at = tag
        if name in PAGE_PARTS and not slash:
            containers.part()
        if name in SKIPPED:
            if slash or (name not in RAW and closed and not _unquoted(attributes)):
                continue
            close = following(CLOSING[name])
            if name in RAW:
                at = CLOSING[name].match(page, close).end() if close < len(page) else len(page)
            elif close < following(BARRIERS.get(name, BARRIER)) and (name in NESTED or close < following(OPENING[name])):
                at = CLOSING[name].match(page, close).end()
        elif name == "a":
            in_link = 0 if slash else 1
        elif name == "br":
            pieces.append(" ")
        elif name in BLOCKS:
            end()
            if name in CONTAINERS:
                if slash:
                    containers.leave(name)
                elif not closed:
                    if name == "body":
                        containers.leave("head")
                    containers.enter(name, _marks(name, attributes))
            elif not slash:
                own = _marks(name, attributes)[:2]
                heading = int(len(name) == 2 and name[0] == "h" and name[1].isdigit())
    end()
    boiler, content = containers.marks()
    return [Block(text, words, links, int(boiler[k] or own[0]), int(content[k] or own[1]), heading) for text, words, links, k, own, heading in found]


def features(found: list[Block]) -> np.ndarray:
    """words, links, words and links of the block before, of the block after, boiler, content, heading."""
    own = np.array([(b.words, b.links) for b in found], float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    marks = np.array([(b.boiler, b.content, b.heading) for b in found], float).reshape(-1, 3)
    return np.hstack((own, np.vstack((edge, own[:-1])), np.vstack((own[1:], edge)), marks)) if found else np.zeros((0, 9))


#: Labelled pages, one a line.  A block is + (main text) or -, its words, its link density in tenths where it has any, and its
#: marks: b inside boilerplate, c inside content, h a heading.
PAGES = """
-1.10b -1.10b -1.10b -2.10b -1.10b -8b +7ch +120c +60c +45c +3c -12b
-1.10b -1.10b -1.10b -1.10b -9b +4ch +30.2c +50c +1c +90c +6c -30.1b
-1.10b -2.10b -1.10b -1.10b -25.1b +9ch +2c -6b
-2.10b -1.10b -1.10b -3.10b -15b +8ch +400.05c -15bc +80c +5c +70c -40bc -60bc -45bc -4bch -9b
-1.10 -1.10 -2.10 -1.10 -1.10 -2.10 +6h +70 +50 +40 -3.10 -4.10 -2.10 -6.1
-1.10 -1.10 -3.10 -2.10 +5h +90.1 +4 +60 +25 -8.9 -25.7 -12.9 -5
-2.10 -1.10 -1.10 -4.10 -5 -2.10 +8h +200.2 +100.1 +18 +6h +60 +3 +45 -3.10 -1.10 -1.10 -2.5 -3 -2
-1.10 -1.10 -1.10 -3 -5 -4 -2.10 -1.10 +7h +35 +30.1 +14.2 +20 -1.10 -1.10 -1.10
-1.10b -1.10b -1.10b -1.10b -60b -40b -50b +3ch +12c +1c +1c +2c +10.9c +30c +30c -4bh -3.10b -2.10b -90.3b
-3.10 -1.10 -2.10 -20.8 -15.7 -30.6 -3.10 -4.10 -7.5 +50 +40 +60 -1.10 -1.10
-1.10b -1.10b -1.10b +16 +30 +5h +60 +40 +4 +50 -2.10b -2.10b -2.10b -6b
-1.10 -1.10 -1.10 -1.10 +25 -1.10 -2.10 -1.10 -1.10 -4
-1.10b -1.10b -1.10b -1.10b -1.10b -1.10b -2.10b +6ch +25c +2c +7ch +60c +3.10c +50c +4ch +1c +1c -3b -5.2b -2.10b -1.10b -1.10b
-2.10b -2.10b -2.10b -1.10b -12.1b +10ch +40.1c +18.3c +22.6c +35c -20b -35b -18b -5.10b -4.10b -8b
+3ch +7c
+120 +80.1 +40
-1.10 -1.10 -1.10 -5.8 +20 +30.1 +60 -2.10 -60.7 -80.8 -1.10
-1.10 -2.10 +6h +60 +12 +80.1 +7 +70 -4 -26.8 -31.9 -24.7 -5 -40.8 -6
-1.10 -5 -30.8 -42.9 -6 -28.7 +7h +50 +9 +66.1 +5 +31 -8 -33.9
"""


def _table() -> np.ndarray:
    """The nine features of the blocks of PAGES, then 1 for main text."""
    out = []
    for line in PAGES.split("\n"):
        found, labels = [], []
        for label, words, links, marks in re.findall(r"([+-])(\d+)(?:\.(\d+))?([bch]*)", line):
            density = 1.0 if links == "10" else float(f"0.{links or 0}")
            found.append(Block("", int(words), density, int("b" in marks), int("c" in marks), int("h" in marks)))
            labels.append(label == "+")
        out.append(np.hstack((features(found), np.array(labels, float)[:, None])))
    return np.vstack(out)


class Tree(NamedTuple):
    """A node with column < 0 is a leaf of class threshold."""

    column: int
    threshold: float
    low: Tree | None = None
    high: Tree | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.column < 0:
            return np.full(len(x), self.threshold > 0.5)
        up = x[:, self.column] > self.threshold
        return np.where(up, self.high(x), self.low(x))


def train(rows: np.ndarray, depth: int = 6) -> Tree:
    """A CART tree: the split of least Gini impurity, of equals the first column and lowest threshold."""
    x, y = rows[:, :-1], rows[:, -1]
    best = None
    if depth and y.min() != y.max():
        for c in range(x.shape[1]):
            values = np.unique(x[:, c])
            for t in (values[1:] + values[:-1]) / 2:
                up = x[:, c] > t
                p, q = y[up].mean(), y[~up].mean()
                gini = up.mean() * p * (1 - p) + (~up).mean() * q * (1 - q)
                if best is None or gini < best[0] - 1e-12:
                    best = gini, c, t, up
    if best is None:
        return Tree(-1, float(y.mean()))
    _, c, t, up = best
    return Tree(c, float(t), train(rows[~up], depth - 1), train(rows[up], depth - 1))


#: What the tree learns from.
TABLE = _table()


def main_text(page: str, tree: Tree) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, ok in zip(found, tree(features(found)), strict=True) if ok) if found else ""


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html).

    Null or empty html gives an empty text; repeated rows are rows; an empty table gives an empty result; other columns are left out.
    """
    tune(pages.sparkSession)
    tree = tree or train(TABLE)

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py() or "", tree) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    page_id = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {page_id}, url string, text string, n_chars long")


def op8_html_main_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
