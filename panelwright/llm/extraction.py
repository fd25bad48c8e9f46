"""Main text of web pages: flat text blocks classified by a decision tree.

A page is read once, tag by tag. Text between block-level tags is a block; inline tags don't split
it. A block knows its number of words, its link density (share of characters inside links), the same
two numbers of the blocks before and after it, whether it stands in a container of page furniture
(navigation, header, footer, sidebar, form, advert, notice, comments, by element or by the words of
its class, id or role; half where the same name speaks of content too), whether it stands in an article or main element, and whether its own element
is a paragraph or heading. A decision tree (Gini, grown here from ``LABELLED``) decides on these
nine numbers. Blocks that stay are joined in page order by an empty line.

Scripts, styles, buttons, drawings, hidden elements and comments of the markup are skipped whole; character references are decoded
once; white space in a block becomes one space. Nothing is dropped for its length.

Rows: a null or empty page, or one without text, has an empty text; malformed or cut-off markup is
read as far as it goes; repeated rows are read one by one; other columns are not read.
"""
from __future__ import annotations

import html
import re
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from panelwright.llm.common import with_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RAW = "script|style|noscript|iframe|textarea|title"
UNSHOWN = frozenset("svg math object template select button".split())
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)", re.S | re.I)
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
CONTAINERS = frozenset("div section article main nav header footer aside form ul ol dl table body figure menu dialog fieldset blockquote details".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
# words of class and id: of furniture whatever stands beside them; of furniture unless a content word does; of content
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside widget "
    "cookie cookies consent gdpr popup newsletter related recommended comment comments discussion disqus reply replies respond pagination pager "
    "copyright complementary contentinfo".split())
DOUBTFUL = frozenset(
    "promo promotion banner header masthead notice alert modal overlay subscribe signup login share sharing social search toolbar legal disclaimer skip".split())
CONTENT = frozenset("content article story post entry text body main".split())
ROLES = frozenset("banner navigation complementary contentinfo search alert alertdialog dialog menu menubar toolbar".split())
NAMED = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?<![\w-])(?:hidden(?![\w-])(?!\s*=\s*["']?until-found)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden))""", re.I)
QUOTED = re.compile(r"""(?<![\w-])(?!(?:style|aria-hidden)\s*=)[\w:-]+\s*=\s*(?:"[^"]*"|'[^']*')""", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt td figcaption".split())

#: A small labelled table. Columns: words and link density of the block, of the one before, of the
#: one after; in furniture; in an article; paragraph or heading; label (1: main text).
LABELLED = [
    (6, 0, 0, 0, 60, 0, 0, 1, 1, 1), (70, 0.02, 6, 0, 45, 0, 0, 1, 1, 1), (3, 0, 80, 0, 50, 0, 0, 1, 1, 1), (1, 0, 20, 0, 90, 0, 0, 1, 1, 1),
    (120, 0, 1, 0, 10, 0, 0, 1, 1, 1), (25, 0.3, 60, 0, 40, 0, 0, 1, 1, 1), (4, 0, 8, 1, 70, 0, 0, 1, 1, 1), (12, 0, 90, 0.1, 9, 0.3, 0, 1, 1, 1),
    (8, 0, 7, 0, 6, 0, 0, 1, 1, 1), (2, 0, 30, 0, 0, 0, 0, 1, 1, 1), (6, 0.95, 40, 0, 30, 0, 0, 1, 1, 1), (9, 0.95, 80, 0, 90, 0, 0, 1, 1, 1), (3, 1, 20, 0, 200, 0, 0, 1, 1, 1), (5, 1, 30, 0, 60, 0, 0, 0, 1, 0), (7, 0.9, 60, 0, 40, 0, 0, 0, 0, 0), (300, 0, 12, 0, 8, 0, 0, 1, 1, 1),
    (5, 0, 200, 0, 9, 0, 0, 1, 1, 1), (9, 0, 150, 0, 300, 0, 0, 1, 1, 1), (40, 0, 3, 0, 2, 0, 0, 1, 1, 1), (1, 0, 2, 0, 3, 0, 0, 1, 1, 1),
    (18, 0, 110, 0, 12, 0, 0, 1, 1, 1), (90, 0, 95, 0, 5, 1, 0, 1, 1, 1), (55, 0.1, 2, 0, 3, 0, 0, 1, 0, 1), (9, 0, 50, 0, 40, 0, 0, 1, 0, 1),
    (14, 0, 120, 0, 10, 0, 0, 1, 0, 1), (3, 1, 4, 1, 3, 1, 0, 1, 1, 0), (2, 1, 2, 1, 5, 1, 0, 1, 1, 0), (4, 1, 60, 0, 3, 1, 0, 1, 1, 0),
    (1, 1, 0, 0, 1, 1, 1, 0, 1, 0), (2, 1, 1, 1, 1, 1, 1, 0, 1, 0), (15, 0.4, 3, 0, 2, 1, 1, 0, 1, 0), (3, 0, 5, 0, 4, 0, 1, 0, 1, 0),
    (110, 0, 12, 0, 14, 0, 1, 0, 1, 0), (40, 0, 90, 0, 30, 0, 1, 0, 1, 0), (60, 0, 2, 1, 200, 0, 1, 0, 1, 0), (8, 0, 40, 0, 70, 0, 1, 0, 1, 0),
    (25, 0.1, 100, 0, 120, 0, 1, 0, 1, 0), (7, 0, 1, 1, 10, 0, 1, 0, 0, 0), (9, 0, 80, 0, 0, 0, 1, 0, 0, 0), (12, 0, 1, 1, 60, 0, 1, 0, 0, 0),
    (200, 0, 10, 0, 90, 0, 1, 0, 0, 0), (6, 0.5, 300, 0, 50, 0, 1, 0, 0, 0), (10, 0, 4, 1, 150, 0, 1, 0, 0, 0), (30, 0, 20, 0, 20, 0, 1, 1, 1, 0),
    (60, 0, 50, 0, 10, 0, 1, 1, 1, 0), (4, 0, 70, 0, 0, 0, 1, 1, 1, 0), (22, 0, 90, 0, 110, 0, 1, 1, 1, 0), (5, 0, 100, 0, 80, 0, 1, 1, 0, 0),
    (35, 0, 60, 0, 90, 0, 1, 1, 0, 0), (45, 0, 5, 0, 60, 0, 0, 0, 1, 1), (80, 0.05, 40, 0, 30, 0, 0, 0, 1, 1), (30, 0, 70, 0.1, 4, 1, 0, 0, 1, 1),
    (7, 0, 2, 1, 60, 0, 0, 0, 1, 1), (5, 0, 60, 0, 70, 0, 0, 0, 1, 1), (16, 0, 30, 0, 40, 0, 0, 0, 1, 1), (6, 0, 0, 0, 0, 0, 0, 0, 1, 1),
    (24, 0, 130, 0, 3, 1, 0, 0, 1, 1), (60, 0.1, 100, 0, 110, 0, 0, 0, 1, 1), (9, 0.2, 90, 0, 80, 0, 0, 0, 1, 1), (25, 0.1, 3, 1, 50, 0, 0, 0, 0, 1),
    (150, 0, 0, 0, 0, 0, 0, 0, 0, 1), (40, 0, 2, 1, 3, 1, 0, 0, 0, 1), (70, 0, 90, 0, 100, 0, 0, 0, 0, 1), (3, 0, 2, 1, 1, 1, 0, 0, 1, 0),
    (4, 1, 60, 0, 3, 1, 0, 0, 1, 0), (6, 0.9, 90, 0, 100, 0, 0, 0, 1, 0), (3, 1, 2, 1, 80, 0, 0, 0, 1, 0), (20, 0.8, 30, 0, 2, 1, 0, 0, 0, 0),
    (2, 0, 3, 1, 5, 0.9, 0, 0, 0, 0), (6, 0, 4, 0.5, 3, 0, 0, 0, 0, 0), (8, 0.6, 5, 1, 4, 1, 0, 0, 0, 0), (4, 0, 5, 0, 6, 0, 0, 0, 0, 0),
    (5, 0, 0, 0, 3, 1, 0, 0, 0, 0), (10, 0, 3, 1, 8, 0, 0, 0, 0, 0), (12, 0, 8, 0, 0, 0, 0, 0, 0, 0), (8, 0, 120, 0, 0, 0, 0, 0, 0, 0),
    (3, 0, 90, 0, 1, 1, 0, 0, 0, 0),
    (5, 0, 2, 1, 60, 0, 0.5, 0, 1, 1), (60, 0, 5, 0, 80, 0, 0.5, 0, 1, 1), (4, 0, 70, 0, 50, 0, 0.5, 0, 1, 1), (30, 0.1, 60, 0, 3, 1, 0.5, 0, 1, 1),
    (15, 0, 40, 0, 0, 0, 0.5, 0, 1, 1), (90, 0, 3, 1, 4, 1, 0.5, 0, 0, 1), (45, 0.2, 80, 0, 20, 0, 0.5, 0, 0, 1), (20, 0, 5, 0, 6, 0, 0.5, 0, 1, 1),
    (3, 0, 0, 0, 4, 0, 0.5, 0, 1, 0), (4, 0, 3, 0, 2, 1, 0.5, 0, 1, 0), (3, 1, 4, 1, 3, 1, 0.5, 0, 1, 0), (2, 1, 60, 0, 2, 1, 0.5, 0, 0, 0),
    (12, 0.9, 5, 1, 6, 1, 0.5, 0, 1, 0), (4, 0, 2, 1, 3, 1, 0.5, 0, 0, 0), (5, 0, 1, 1, 0, 0, 0.5, 0, 0, 0), (3, 0.9, 50, 0, 70, 0, 0.5, 0, 1, 0),
]


@dataclass
class Block:
    text: str
    words: int
    links: float
    furniture: float
    article: bool
    paragraph: bool


def mark(attributes: str, container: bool, heading: bool) -> float:
    """1: named as page furniture; 0.5: named both so and as content; 0: neither.

    A name is split at hyphens and underscores. A doubtful word counts only half beside a content
    word (``post-header-content``, ``story share``), and not at all on a heading.
    """
    doubtful = content = False
    for attribute, *values in NAMED.findall(attributes):
        names = "".join(values).lower().split()
        if attribute.lower() == "role" and not ROLES.isdisjoint(names):
            return 1.0
        for name in names:
            words = re.split("[_-]+", name)
            if not FURNITURE.isdisjoint(words):
                return 1.0
            doubtful |= not DOUBTFUL.isdisjoint(words)
            content |= words[-1] in CONTENT
    if not doubtful or heading:
        return 0.0
    return 0.5 if content and container else 1.0


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    # containers, and other elements that are marked: element, furniture, article, hidden; the last three inherited
    stack: list[tuple[str, float, bool, bool]] = []
    in_link, element, unseen = False, "", ""  # ``unseen``: the hidden inline element that is open

    def cut() -> None:
        if parts:
            _, furniture, article, hidden = stack[-1] if stack else ("", 0.0, False, False)
            whole = "" if hidden else html.unescape("".join(t for t, _ in parts))
            text = " ".join(whole.split())
            if text:
                linked = sum(len("".join(html.unescape(t).split())) for t, k in parts if k)
                out.append(Block(text, text.count(" ") + 1, min(1.0, linked / max(1, len(text.replace(" ", "")))), furniture, article, element in PARAGRAPHS))
            parts.clear()

    def leave(name: str, within: frozenset[str] = frozenset()) -> None:
        """Close the innermost open ``name``, unless an element of ``within`` stands inside it."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                del stack[k:]
                return
            if stack[k][0] in within:
                return

    at, without_end = 0, set()
    while m := MARKUP.search(page, at):
        if m.start() > at and not unseen:
            parts.append((page[at : m.start()], in_link))
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        attributes = m[4] or ""
        alone = attributes.rstrip().endswith("/")
        if name in UNSHOWN:
            if not m[2] and not alone and name not in without_end:
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
                else:
                    without_end.add(name)
            continue
        hidden = bool(attributes) and not m[2] and name not in VOID and not alone and bool(HIDDEN.search(QUOTED.sub("", attributes)))
        if name in INLINE:
            if name == unseen and m[2]:
                unseen = ""
            elif hidden and not unseen:
                unseen = name
            if name == "a":
                in_link = not m[2]
            elif name == "br" and not unseen:
                parts.append((" ", in_link))
            continue
        cut()
        in_link, unseen = False, ""
        if m[2]:
            leave(name, frozenset() if name in CONTAINERS else CONTAINERS)
            element = ""
            continue
        element = name
        container, heading = name in CONTAINERS, name in HEADINGS
        # a paragraph or heading ends at the next block, a list item or cell at the next of its kind
        while stack and (stack[-1][0] == "p" or stack[-1][0] in HEADINGS):
            stack.pop()
        if not container:
            leave(name, CONTAINERS)
        if alone or name in VOID:
            continue
        _, furniture, article, unshown = stack[-1] if stack else ("", 0.0, False, False)
        main = name in ("article", "main")
        own = 0.0 if main or name in ("body", "html") else mark(attributes, container, heading) if attributes else 0.0
        if name in FURNITURE_TAGS or (name == "header" and not article):
            own = 1.0
        inherited = 0.0 if main and furniture < 1 else furniture
        if container or own or hidden:
            stack.append((name, max(inherited, own), article or main, unshown or hidden))
    if at < len(page) and not unseen:
        parts.append((page[at:], in_link))
    cut()
    return out


def features(blocks: list[Block]) -> np.ndarray:
    own = np.array([[b.words, b.links, b.furniture, b.article, b.paragraph] for b in blocks], dtype=np.float64).reshape(-1, 5)
    edge = np.zeros((1, 2))
    before, after = np.vstack([edge, own[:-1, :2]]), np.vstack([own[1:, :2], edge])
    return np.hstack([own[:, :2], before, after, own[:, 2:]])[: len(blocks)]


class Tree:
    """A binary decision tree: smallest Gini impurity, thresholds half way between values."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8):
        self.vote, self.column = float(y.mean()), -1
        if depth == 0 or self.vote in (0.0, 1.0):
            return
        best = (np.inf, -1, 0.0)
        for c in range(x.shape[1]):
            values = np.unique(x[:, c])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[:, c] <= cut
                score = sum(len(part) * part.mean() * (1 - part.mean()) for part in (y[low], y[~low]))
                best = min(best, (round(score, 9), c, float(cut)))
        if best[1] >= 0:
            _, self.column, self.cut = best
            low = x[:, self.column] <= self.cut
            self.low, self.high = Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1)

    def keeps(self, x: np.ndarray) -> np.ndarray:
        if self.column < 0:
            return np.full(len(x), self.vote >= 0.5)
        low = x[:, self.column] <= self.cut
        out = np.empty(len(x), dtype=bool)
        out[low], out[~low] = self.low.keeps(x[low]), self.high.keeps(x[~low])
        return out


def grow(labelled: list[tuple] = LABELLED) -> Tree:
    rows = np.array(labelled, dtype=np.float64)
    return Tree(rows[:, :-1], rows[:, -1])


def main_text(page: str | None, tree: Tree) -> str:
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    return "\n\n".join(b.text for b, keep in zip(blocks, tree.keeps(features(blocks))) if keep)


def extract(pages: DataFrame, keep: list[str], labelled: list[tuple] = LABELLED) -> DataFrame:
    """``keep`` and the main ``text`` of every page, with ``n_chars``, its code points."""
    tree = grow(labelled)

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = [main_text(t.as_py(), tree) for t in batch.column(batch.schema.get_field_index("html"))]
            return [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]

        return work

    return with_batches(pages, make, "text string, n_chars long", [c for c in keep if c not in ("text", "n_chars")])
