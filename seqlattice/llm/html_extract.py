"""Main text of web pages by a graphical model over the DOM tree.

Every element of a page is content or not.  The score of an element depends on its kind, the words of its class, id and
role, and the text and links below it; the score of a pair depends on the labels of parent and child.  Messages go up
the tree and down again (sum-product), which gives each element's marginal; an element's own text is kept where that is
above one half.  The weights start from priors and are fitted by the gradient of the likelihood, computed from the same
marginals, on at most ``TRAINING_PAGES`` labelled pages: pages whose markup names their one article, once as they are
and once with all names of elements and classes hidden, so that text and place weigh in where markup is silent.

Text: character references are decoded, runs of ``[\\x20\\x09-\\x0D]`` inside a block become one space, ends are
trimmed, and blocks are joined by one space.

Defined cases: a null or empty page has no text; repeated rows are read each by itself; an empty table gives no rows, and
one without labelled pages is read with the priors.  Only the id, url and html columns are read, so other columns can't
clash.  A page of any length is read whole, in one pass.  Text deeper than ``DEEPEST`` elements is that level's.  Unclosed and misnested elements are closed as browsers do for paragraphs, list items and table cells, else at the
end of an element around them.  A probability of one half is no content.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch

TRAINING_PAGES, TRAINING_STEPS = 300, 60
#: Pages longer than this aren't used for training.
TRAINING_BYTES = 65_536
DEEPEST = 512

#: A tag up to its end; quotes count after an equals sign and where they are closed.  Nothing is ever tried twice.
_TAG = re.compile(r"""</?+[a-zA-Z](?:[^>=]++|=[ \t\n\f\r]*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
#: A comment as browsers end it: at once, or with the first --> or --!>.  A declaration ends with the first >.
_COMMENT = re.compile(r"<!--(?:-?+>|(?s:.*?)--!?>)")
_DECLARATION = re.compile(r"<[!?][^>]*+>")
_TAG_NAME = re.compile(r"</?+([a-zA-Z][^ \t\n\f\r/>]*+)")
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"[ \t\n\x0b\x0c\r]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template xmp svg math".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_SKIP = frozenset("head script style noscript template title iframe svg math object canvas audio video map".split())
_ENDS_P = frozenset("address article aside blockquote details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section table ul".split())
#: What a start tag closes, if it is open inside the nearest of the bounds.
_CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}

#: Words of class, id and role names that speak for and against an element.
FOR_WORDS = frozenset("article articlebody content entry post story main body text prose".split())
AGAINST_WORDS = frozenset("ad ads advert advertisement adverts aside banner bar breadcrumb breadcrumbs byline captcha comment commentlist comments consent contentinfo cookie cookies disclaimer disqus feedback foot footer form gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promoted promotion reactions reader recommend recommended related replies reply respond search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe tags teaser toolbar topbar widget".split())
_KINDS = {
    "article": ("article",), "main": ("main",), "prose": ("p", "blockquote", "pre", "figcaption", "td", "dd", "dt", "th"), "heading": ("h1", "h2", "h3", "h4", "h5", "h6"),
    "list": ("ul", "ol", "li", "dl"), "frame": ("nav", "footer", "header", "aside", "menu", "dialog", "search"), "form": ("form", "button", "select", "option", "input", "fieldset", "label"), "link": ("a",),
}
_KIND_OF = {tag: kind for kind, tags in _KINDS.items() for tag in tags}
FEATURES = ["bias", *_KINDS, "other", "for", "against", "text", "links", "no_text", "sentences"]
_AT = {k: i for i, k in enumerate(FEATURES)}
#: Where the weights start, and what they are drawn to: log odds of content.
PRIOR = {"bias": -0.5, "article": 14.0, "main": 7.0, "prose": 1.0, "heading": 0.5, "list": 0.0, "frame": -12.0, "form": -12.0, "link": 0.0, "other": 0.0, "for": 4.0, "against": -12.0, "text": 1.0, "links": -3.0, "no_text": -0.5, "sentences": 1.0}
#: Log potential of (label of the parent, label of the child), by what the parent or the child is: an unmarked parent, a
#: parent marked as a frame, form or notice, one marked as an article or its like, and any parent of an inline element.
PLAIN, FRAME, ARTICLE, INLINE = range(4)
PAIR_PRIOR = np.array([[[1.0, -1.0], [-3.0, 1.5]], [[2.0, -12.0], [0.0, 0.0]], [[0.0, -4.0], [-4.0, 2.0]], [[4.0, -8.0], [-8.0, 4.0]]])
_DRAWN = 0.05


@dataclass
class Page:
    """Elements in page order (the root first), and the text in page order as (element, text) or (-1, "") for a break."""

    parent: list[int]
    depth: list[int]
    tags: list[str]
    names: list[str]
    pieces: list[tuple[int, str]]


def parse(page: str) -> Page:
    """The elements and the text of a page, in one pass.

    A quote that is never closed ends with its tag; a tag that is never closed ends the page.
    """
    parent, depth, tags, names = [0], [0], [""], [""]
    pieces: list[tuple[int, str]] = []
    stack = [0]
    opened: Counter[str] = Counter()
    beyond: Counter[str] = Counter()  # tags open below DEEPEST
    strict = True  # until a tag has no end outside quotes
    at = text_from = 0

    def close(tag: str, bounds: tuple[str, ...] = ()) -> None:
        if beyond[tag]:
            beyond[tag] -= 1
            return
        if not opened[tag]:
            return
        for i in range(len(stack) - 1, 0, -1):
            if tags[stack[i]] == tag:
                opened.subtract(tags[x] for x in stack[i:])
                del stack[i:]
                return
            if tags[stack[i]] in bounds:
                return

    def text(to: int) -> None:
        if text_from < to:
            pieces.append((stack[-1], page[text_from:to]))

    while (at := page.find("<", at)) >= 0:
        following = page[at + 1 : at + 2]
        if following in ("!", "?"):
            text(at)
            m = (_COMMENT if page.startswith("<!--", at) else _DECLARATION).match(page, at)
            at = text_from = m.end() if m else len(page)
            continue
        named = _TAG_NAME.match(page, at)
        if named is None:
            at += 1
            continue
        text(at)
        m = _TAG.match(page, at) if strict else None
        end = m.end() if m else page.find(">", named.end()) + 1
        strict = m is not None
        if not end:
            text_from = len(page)
            break
        tag, attributes = named[1].lower(), page[named.end() : end - 1]
        ending = following == "/"
        at = text_from = end
        if tag not in _INLINE:
            pieces.append((-1, ""))
        if ending:
            close(tag)
            continue
        if tag in _VOID:
            continue
        if tag in _ENDS_P:
            close("p", ("button", "td", "th", "table"))
        if tag in _CLOSES:
            for old in _CLOSES[tag][0]:
                close(old, _CLOSES[tag][1])
        if len(stack) >= DEEPEST and tag not in _RAW:
            beyond[tag] += not attributes.endswith("/")
            continue
        new = len(parent)
        above = stack[-1]
        parent.append(above)
        depth.append(depth[above] + 1)
        tags.append(tag)
        names.append(" ".join(x or y or z for x, y, z in _ATTRIBUTE.findall(attributes)).lower() if attributes else "")
        if tag in _RAW:
            closing = re.compile(f"</{re.escape(tag)}[^>]*+>", re.I).search(page, at)
            at = text_from = closing.end() if closing else len(page)
        elif attributes.endswith("/") and tag not in _INLINE and tag not in _ENDS_P:
            continue
        else:
            stack.append(new)
            opened[tag] += 1
    text(len(page))
    return Page(parent, depth, tags, names, pieces)


class Forest:
    """The elements of several pages as arrays, ready for messages."""

    def __init__(self, pages: list[Page], hide: bool = False):
        sizes = [len(p.parent) for p in pages]
        self.begins = np.cumsum(sizes) - sizes
        n = sum(sizes)
        self.parent = np.concatenate([np.array(p.parent, np.int64) + b for p, b in zip(pages, self.begins, strict=True)]) if pages else np.empty(0, np.int64)
        depth = np.concatenate([np.array(p.depth, np.int64) for p in pages]) if pages else np.empty(0, np.int64)
        order = np.argsort(depth, kind="stable")
        cuts = np.flatnonzero(np.diff(depth[order])) + 1
        self.levels = np.split(order, cuts)[1:]
        self.roots = self.begins
        chars, links, ends = np.zeros(n), np.zeros(n), np.zeros(n)
        x = np.zeros((n, len(FEATURES)))
        skip, inline = np.zeros(n, bool), np.zeros(n, bool)
        for p, b in zip(pages, self.begins.tolist(), strict=True):
            for el, t in p.pieces:
                if el >= 0 and (size := len(t.strip())):
                    chars[b + el] += size
                    ends[b + el] += t.count(". ") + t.rstrip().endswith((".", "!", "?"))
                    if p.tags[el] == "a":
                        links[b + el] += size
            for i, (tag, name) in enumerate(zip(p.tags, p.names, strict=True), b):
                skip[i] = tag in _SKIP
                inline[i] = tag in _INLINE
                if hide:
                    x[i, _AT["other"]] = 1
                    continue
                x[i, _AT[_KIND_OF.get(tag, "other")]] = 1
                if name:
                    words = set(_NAME.findall(name))
                    x[i, _AT["for"]] = not words.isdisjoint(FOR_WORDS)
                    x[i, _AT["against"]] = not words.isdisjoint(AGAINST_WORDS)
        own = chars > 0
        children = np.bincount(self.parent, minlength=n)
        children[self.roots] -= 1
        for level in reversed(self.levels):
            for values in (chars, links, ends):
                np.add.at(values, self.parent[level], values[level])
        for level in self.levels:
            skip[level] |= skip[self.parent[level]]
        # a wrapper of one element, without text or names, says nothing: its child hangs on what it hangs on
        wrapper = (x[:, _AT["other"]] > 0) & ~own & (children == 1) & (x[:, [_AT["for"], _AT["against"]]] == 0).all(axis=1)
        wrapper[self.roots] = False
        level_of = np.zeros(n, np.int64)
        for level in self.levels:
            above = self.parent[level]
            self.parent[level] = np.where(wrapper[above], self.parent[above], above)
            level_of[level] = level_of[self.parent[level]] + 1
        level_of[wrapper] = 0
        order = np.argsort(level_of, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(level_of[order])) + 1)[1:]
        x[:, _AT["bias"]] = 1
        x[:, _AT["text"]] = np.log1p(chars) / 5
        x[:, _AT["links"]] = links / np.maximum(chars, 1)
        x[:, _AT["no_text"]] = chars == 0
        x[:, _AT["sentences"]] = ends > 0
        # an inline element has no say of its own but for its names; it goes with the block around it
        x[np.ix_(inline, [_AT[k] for k in ("bias", "text", "links", "no_text", "sentences", "link", "other")])] = 0
        bad = x[:, [_AT[k] for k in ("frame", "form", "against")]].any(axis=1)
        good = x[:, [_AT[k] for k in ("article", "main", "for")]].any(axis=1) & ~bad
        self.edge = np.where(inline, INLINE, np.where(bad[self.parent], FRAME, np.where(good[self.parent], ARTICLE, PLAIN)))
        self.x, self.skip = x, skip

    def marginals(self, weights: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each element, and the summed marginals of (parent, child) label pairs."""
        n = len(self.x)
        belief = np.zeros((n, 2))
        belief[:, 1] = self.x @ weights
        belief[self.skip, 1] = -60
        up = np.zeros((n, 2))
        for level in reversed(self.levels):
            both = pair[self.edge[level]] + belief[level][:, None, :]
            up[level] = np.logaddexp(both[:, :, 0], both[:, :, 1])
            np.add.at(belief, self.parent[level], up[level])
        full = belief.copy()
        pairs = np.zeros_like(pair)
        for level in self.levels:
            above = full[self.parent[level]] - up[level]
            joint = above[:, :, None] + pair[self.edge[level]] + belief[level][:, None, :]
            full[level] = np.logaddexp(joint[:, 0, :], joint[:, 1, :])
            joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
            seen = ~self.skip[level]
            np.add.at(pairs, self.edge[level][seen], (joint / joint.sum(axis=(1, 2), keepdims=True))[seen])
        return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -60, 60))), pairs


def labels_of(pages: list[Page]) -> list[np.ndarray | None]:
    """1 for the elements of the one article that a page's markup names, without frames, forms and notices in it."""
    out: list[np.ndarray | None] = []
    for p in pages:
        if p.tags.count("article") != 1:
            out.append(None)
            continue
        y = np.zeros(len(p.tags), np.int64)
        for i in range(1, len(p.tags)):
            bad = _KIND_OF.get(p.tags[i]) in ("frame", "form") or p.tags[i] in _SKIP or not set(_NAME.findall(p.names[i])).isdisjoint(AGAINST_WORDS)
            y[i] = not bad and (p.tags[i] == "article" or y[p.parent[i]])
        out.append(y)
    return out


def fit(pages: list[Page], steps: int = TRAINING_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights by gradient ascent of the likelihood of the labelled pages, drawn to the priors."""
    start = np.array([PRIOR[k] for k in FEATURES])
    weights, pair = start.copy(), PAIR_PRIOR.copy()
    known = [(p, y) for p, y in zip(pages, labels_of(pages), strict=True) if y is not None]
    if not known:
        return weights, pair
    y = np.concatenate([y for _, y in known])
    forests = [Forest([p for p, _ in known]), Forest([p for p, _ in known], hide=True)]
    for step in range(steps):
        g, gp = np.zeros_like(weights), np.zeros_like(pair)
        for forest in forests:
            p, pairs = forest.marginals(weights, pair)
            seen = ~forest.skip
            g += ((y - p)[seen, None] * forest.x[seen]).sum(axis=0)
            inner = np.concatenate(forest.levels) if forest.levels else np.empty(0, np.int64)
            inner = inner[~forest.skip[inner]]
            gp += np.bincount(4 * forest.edge[inner] + 2 * y[forest.parent[inner]] + y[inner], minlength=16).reshape(4, 2, 2) - pairs
        scale = 1 / (2 * len(known))
        rate = 0.3 / (1 + step / 20)
        weights += rate * (g * scale - _DRAWN * (weights - start))
        pair += rate * (gp * scale - _DRAWN * (pair - PAIR_PRIOR))
    return weights, pair


def text_of(page: Page, content: np.ndarray) -> str:
    parts = []
    for el, t in page.pieces:
        if el < 0:
            parts.append(" ")
        elif content[el]:
            parts.append(html.unescape(t) if "&" in t else t)
    return _SPACE.sub(" ", "".join(parts)).strip(" ")


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches: Iterator[pa.RecordBatch], weights: np.ndarray, pair: np.ndarray, group: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts: list[str] = []
        source = batch.column(2).to_pylist()
        for at in range(0, len(source), group):
            pages = [parse(s or "") for s in source[at : at + group]]
            forest = Forest(pages)
            content = forest.marginals(weights, pair)[0] > 0.5
            texts += [text_of(p, content[b : b + len(p.parent)]) for p, b in zip(pages, forest.begins.tolist(), strict=True)]
        yield record_batch(_OUT, batch.column(0), batch.column(1), texts, [len(t) for t in texts])


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", size: int = TRAINING_PAGES) -> tuple[np.ndarray, np.ndarray]:
    """Fit on ``size`` pages whose markup names an article, in the order of a hash of their id and text.

    The ``size`` least hashes are looked for first, so that no more pages than these leave the executors.
    """
    source = F.col(html_col)
    labelled = pages.filter(F.lower(source).contains("<article") & (F.octet_length(source) <= TRAINING_BYTES))
    hashed = labelled.select(F.xxhash64(F.col(id_col), source).alias("h"), source.alias("page"))
    least = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(size).collect()]
    rows = hashed.filter(F.col("h") <= least[-1]).groupBy("h").agg(F.min("page").alias("page")).collect() if least else []
    return fit([parse(r.page) for r in sorted(rows)])


def html_extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    weights, pair = train(pages, id_col, html_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("page"))
    return rows.mapInArrow(partial(_extract, weights=weights, pair=pair), "page_id long, url string, text string, n_chars long")
