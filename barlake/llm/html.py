"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of tokens.  Every word and every tag has a weight: the
log-odds, learned from labelled pages, that a token of its kind lies in the
main text.  Words score above zero and tags at most zero; words of links and of
elements that stand around main texts score below.  One linear scan finds the
contiguous run of tokens with the largest sum.

What an element is, is learned too: each tag, and each part of a class, id or
role, has the log-odds that elements with it hold main text.  Parts of a name
count apart as its last word, which says what the element is ("article-comments"),
and as what stands before.  Elements whose sum is low are left out of the run,
unless they hold most of the page's running text: a name alone can't take the
main text away.

The run is widened by the article that holds most of it, or else to the smallest
section that encloses it, so that no short first or last paragraph is cut off.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from .common import batched, extended
from .labelled_pages import labelled_pages

# HTML elements by role.
RAW = frozenset("script style textarea noscript template title iframe svg math object select option button canvas audio video head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SECTION = frozenset("article main section div td body".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose nesting is followed; all others may be left open without harm.
NESTED = SECTION | frozenset("nav header footer aside form menu dialog fieldset ul ol dl table blockquote figure".split())
#: Elements that never hold main text.
NEVER = frozenset("nav form menu dialog fieldset".split())
#: Log-odds below which an element is left out, share of the running text that overrules its name, and pages that the weights are learned from.
LOW, MOST, PAGES = -0.2, 0.5, 2500

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: How a block outside the article starts that is a notice of the page.
COPYRIGHT = re.compile(r"\s*(?:copyright\s*)?(?:©|\(c\))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


def features(name: str, attributes: str, in_article: bool) -> list[str]:
    """What is known of an element by its start tag: its tag, and the parts of its names, the last of each apart."""
    at = "@article" if in_article else ""
    out = [name + at]
    if attributes:
        if HIDDEN.search(attributes):
            out.append("hidden")
        for named in " ".join(a or b or c for a, b, c in NAMES.findall(attributes)).lower().split():
            parts = [x for x in re.split(r"[^a-z]+", named) if x]
            out += ["head:" + x + y for x in parts[-1:] for y in {"", at}] + ["part:" + x for x in parts[:-1]]
    return out


@lru_cache(maxsize=256)
def _end_of(name: str) -> re.Pattern:
    """Where an element that isn't nested ends: at its end tag, or for a paragraph at the next block."""
    if name == "p":
        return re.compile(rf"</?(?:{'|'.join(sorted(BLOCK - {'br'}))})(?=[\s/>])", re.I)
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I)


class Piece:
    """A text between two tags: the element around it, whether it is part of a link, and what stood before it."""

    __slots__ = ("text", "node", "link", "tags", "breaks")

    def __init__(self, text: str, node: int, link: bool, tags: tuple, breaks: bool):
        self.text, self.node, self.link, self.tags, self.breaks = text, node, link, tags, breaks


class Page:
    """The texts of a page in order, and its nested elements: parent, name and features of each.

    Markup that isn't well-formed is read as far as it goes, in time and memory
    in proportion to the page however deep its elements are nested.
    """

    def __init__(self, html: str, low=None):
        self.pieces: list[Piece] = []
        self.parent, self.name, self.features = [0], ["body"], [["body"]]
        stack, open_names, in_article = [0], Counter(), [False]
        unclosed: set[str] = set()
        link, breaks, tags, at = False, False, [], 0

        def close_of(name: str, start: int) -> int | None:
            # once there is no end tag there is none further on
            m = None if name in unclosed else _end_of(name).search(html, start)
            if not m:
                unclosed.add(name)
            return m.start() if m else None

        while True:
            m = TOKEN.search(html, at)
            end = m.start() if m else len(html)
            if end > at:
                text = html[at:end]
                if text.isspace():
                    if self.pieces and not breaks:
                        self.pieces.append(Piece(" ", stack[-1], link, (), False))
                else:
                    self.pieces.append(Piece(text, stack[-1], link, tuple(tags), breaks))
                    breaks, tags = False, []
            if not m:
                return
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            closing, attributes = bool(m[1] or m[4]), m[3] if m[2] else m[6] or ""
            tags.append(("/" if closing else "") + name)
            breaks = breaks or name in BLOCK
            if name == "a":
                link = not closing
            elif name in ("p", "li", "div", "td", "article"):
                link = False
            if closing:
                if open_names[name]:
                    while True:
                        node = stack.pop()
                        open_names[self.name[node]] -= 1
                        if self.name[node] == name:
                            break
            elif attributes.endswith("/") and name in VOID:
                continue
            elif name in RAW:
                close = close_of(name, at)
                if name == "head" and close is None:  # an open head ends where the body starts
                    body = re.compile("<body", re.I).search(html, at)
                    close = body.start() if body else None
                at = close if close is not None else at if name in ("head", "option") else len(html)
            elif name in NESTED:
                inner = in_article[stack[-1]]
                self.parent.append(stack[-1])
                self.name.append(name)
                self.features.append(features(name, attributes, inner))
                in_article.append(inner or name in ("article", "main"))
                stack.append(len(self.parent) - 1)
                open_names[name] += 1
            elif name not in VOID and attributes and low is not None and low(features(name, attributes, in_article[stack[-1]])):
                close = close_of(name, at)
                at = close if close is not None else at

    def sums(self, values: list[float]) -> list[float]:
        """For each element what its pieces have together; ``values`` has a number for each piece."""
        out = [0.0] * len(self.parent)
        for p, v in zip(self.pieces, values, strict=True):
            out[p.node] += v
        for node in range(len(out) - 1, 0, -1):  # an element comes after its parent
            out[self.parent[node]] += out[node]
        return out

    def described(self) -> list[list[str]]:
        """The features of each element, with "links" where most of its words are links."""
        words = [len(p.text.split()) for p in self.pieces]
        linked = self.sums([n if p.link else 0 for p, n in zip(self.pieces, words, strict=True)])
        return [[*f, "links"] if x * 2 > n else f for f, x, n in zip(self.features, linked, self.sums(words), strict=True)]

    def below(self, chosen: list[bool]) -> list[bool]:
        """Which elements are chosen or lie in one that is."""
        out = list(chosen)
        for node in range(1, len(out)):
            out[node] = out[node] or out[self.parent[node]]
        return out


def regression(rows: list[list[str]], inside: list[bool], rounds: int = 300) -> dict[str, float]:
    """Weights of a logistic regression on sets of features, with a little L2: what each says beside the others."""
    names = {x: k for k, x in enumerate(sorted({x for row in rows for x in row}))}
    at = np.array([names[x] for row in rows for x in row])
    owner = np.repeat(np.arange(len(rows)), [len(row) for row in rows])
    y, w = np.array(inside, float), np.zeros(len(names))
    seen = np.full(len(names), 1e-6)
    for _ in range(rounds):
        miss = 1 / (1 + np.exp(-np.bincount(owner, w[at], len(rows)))) - y
        slope = np.bincount(at, miss[owner], len(names)) + 0.1 * w
        seen += slope * slope
        w -= 0.5 * slope / np.sqrt(seen)
    return dict(zip(names, w.tolist(), strict=True))


@dataclass(frozen=True)
class Weights:
    """``tokens``: words, link words and tags; ``elements``: what start tags say."""

    tokens: dict[str, float]
    elements: dict[str, float]

    def low(self, kinds: list[str]) -> bool:
        """Whether an element with these features holds no main text."""
        return "hidden" in kinds or sum(self.elements.get(k, 0.0) for k in kinds) < LOW


@lru_cache(maxsize=1)
def weights() -> Weights:
    """Log-odds of tokens and of elements' features from the labelled pages."""
    in_tokens, out_tokens = Counter(), Counter()
    rows, inside = [], []
    for html, main in labelled_pages(PAGES):
        content = set(main.split())
        page = Page(html)
        counts = [len(unescape(p.text).split()) for p in page.pieces]
        mine = [n if n and sum(w in content for w in unescape(p.text).split()) * 2 > n else 0 for n, p in zip(counts, page.pieces, strict=True)]
        for p, n, m in zip(page.pieces, counts, mine, strict=True):
            if n:
                where = in_tokens if m else out_tokens
                where["link" if p.link else "word"] += n
                where.update("<" + t for t in p.tags)
        total, own = page.sums(counts), page.sums(mine)
        holds = [own[k] * 2 > total[k] for k in range(len(total))]
        described = page.described()
        around = page.below([k > 0 and not holds[k] for k in range(len(total))])
        for k in range(1, len(total)):
            # what lies in an element that is left out says nothing more
            if total[k] and not (around[page.parent[k]] and page.parent[k]):
                rows.append(sorted(set(described[k])))
                inside.append(holds[k])
    n_in, n_out = in_tokens.total(), out_tokens.total()
    tokens = {k: math.log((in_tokens[k] + 0.5) / n_in) - math.log((out_tokens[k] + 0.5) / n_out) for k in (*in_tokens, *out_tokens)}
    # no tag speaks for the main text, and none outweighs a few words; those that the labelled pages lack weigh like the mean one
    tokens = {k: max(-0.5, min(v, -0.05)) if k[0] == "<" else max(-1.0, v) for k, v in tokens.items()}
    tags = [v for k, v in tokens.items() if k[0] == "<"]
    tokens["<"] = sum(tags) / len(tags)
    return Weights(tokens, regression(rows, inside))


def best_run(scores: list[float]) -> tuple[int, int]:
    """Bounds [a, b) of the contiguous run with the largest sum; the first of several; (0, 0) if none is above zero."""
    best, a, b = 0.0, 0, 0
    total, start = 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, a, b = total, start, i + 1
    return a, b


def main_text(html: str | None) -> str:
    """The main text of a whole page; empty for null, for an empty page and for one without main text.

    Character references are decoded, white space inside a block becomes one
    space, and blocks are joined in page order by one space.  Time and memory
    grow in proportion to the page.
    """
    table = weights()
    page = Page(html or "", table.low)
    found = page.pieces
    counts = [len(p.text.split()) for p in found]
    prose = [0 if p.link else n for p, n in zip(found, counts, strict=True)]
    # an element that is left out by its names, not its tag, stays if it holds most of what isn't a link
    never = page.below([x in NEVER for x in page.name])
    held = page.sums([0 if never[p.node] else n for p, n in zip(found, prose, strict=True)])
    aside = page.below([
        k > 0 and (page.name[k] in NEVER or (table.low(kinds) and (table.low(kinds[:1]) or "hidden" in kinds or held[k] <= MOST * held[0]))) for k, kinds in enumerate(page.described())
    ])
    tokens, tag = table.tokens, table.tokens["<"]
    scores = [
        # what is left out anyway neither helps nor hurts the run that spans it
        0.0 if aside[p.node] else n * tokens["link" if p.link else "word"] + sum(tokens.get("<" + t, tag) for t in p.tags)
        for p, n in zip(found, counts, strict=True)
    ]
    a, b = best_run(scores)
    in_run = [n if a <= k < b and not aside[p.node] else 0 for k, (p, n) in enumerate(zip(found, counts, strict=True))]
    of_run = page.sums(in_run)
    if not of_run[0]:
        return ""
    # elements come after their parents, so of those that hold enough the last is the innermost
    whole = [k for k, x in enumerate(of_run) if x == of_run[0]]
    most = [k for k, x in enumerate(of_run) if x * 5 >= of_run[0] * 3]
    articles = [k for k in most if page.name[k] == "article"] or [k for k in most if page.name[k] == "main"]
    common = page.below([k == (articles or whole)[-1] for k in range(len(of_run))])
    out: list[str] = []
    skipped = notice = False
    for k, p in enumerate(found):
        skipped = skipped or p.breaks
        notice = (notice and not p.breaks) or COPYRIGHT.match(unescape(p.text)) is not None
        # the element only widens: of the run, copyright lines outside it are all that goes
        if aside[p.node] or (not common[p.node] and (notice or not a <= k < b)):
            skipped = True
            continue
        if p.breaks or skipped:
            out.append(" ")
            skipped = False
        out.append(unescape(p.text))
    return " ".join("".join(out).split())


def extract(pages: DataFrame, *, html_col: str = "html", text_col: str = "main_text", length_col: str = "main_chars") -> DataFrame:
    """Add the main text of every whole page and its number of code points.

    Null and empty pages give an empty text.  Repeated pages give equal texts,
    very long ones are read whole, and an empty table stays empty.
    Columns of these names in the input are replaced; all others pass through.
    """
    keep = [c for c in pages.columns if c.lower() not in (text_col.lower(), length_col.lower())]
    base = pages.select(*[F.col(f"`{c}`") for c in keep])
    schema = extended(base, **{text_col: StringType(), length_col: LongType()})

    def run(batches):
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(b.schema.names.index(html_col))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, text_col, length_col]
            )

    return batched(base).mapInArrow(run, schema)
