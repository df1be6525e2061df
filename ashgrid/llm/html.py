"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing and
threshold clustering.

The standard-library parser streams tags and text.  Block-level tags cut the page into lines, so
the "line" of the ratio is one rendered block, however the source is wrapped.  A line's ratio is its
text outside links over its number of tags; lines of page furniture (menus, page headers and
footers, sidebars, notices, adverts, forms, reader comments) count as having no text.  The ratios
are smoothed along the page with a Gaussian; runs above the threshold are the content clusters.
All clusters and all article (or main) elements together name the content region: their smallest
common ancestor, or the outermost article or main around that.  All its lines but furniture are
returned; where the ancestor is no article or main, its ends are cut at the first line beyond the
clusters that is mostly links.

A class or id hints at furniture.  A hint does not hold for an element around an article or main, for
one with half of the page's text (a whole-word hint such as "comments": only on a page without other
article or main), nor, unless it is a whole word, for an article.  A page that would lose every line
is read without hints, then without the furniture that holds half of its text, then without any.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = set("""address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav
noscript ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style head title template noscript iframe object svg math canvas audio video".split())
FURNITURE = set("nav aside footer form button select textarea menu dialog fieldset".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
HINTS = set("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies
consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login
sidebar sidebars aside related recommended share sharing social comment comments commentlist discussion disqus replies
menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar widget widgets
pagination pager tags outbrain taboola""".split())
CONTENT = {"article", "main"}
HEAD = set("base basefont bgsound head link meta noscript script style template title".split())
CLOSES_P = BLOCK - {"br", "button", "option", "optgroup", "select", "textarea", "iframe", "noscript"}


def _hinted(value: str) -> str | None:
    """"hint" if a whole word of ``value`` hints at furniture, "part" if the first or last part of one does."""
    tokens = value.lower().split()
    if any(t in HINTS for t in tokens):
        return "hint"
    parts = [re.split(r"[-_:]+", t) for t in tokens]
    return "part" if any(len(x) > 1 and (x[0] in HINTS or x[-1] in HINTS) for x in parts) else None


class _Lines(HTMLParser):
    """Turns a page into lines: (text, link characters, tags, regions, element), where regions are the open
    elements that matter (content containers, furniture) and element is the innermost open one.

    ``elements`` holds per element (tag, enclosing element or -1, region or -1), ``spans`` its lines [from, to)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, tuple[int, ...], int]] = []
        self.stack: list[tuple[str, int]] = []      # (tag, region or -1)
        self.path: list[int] = []                   # the elements of the stack
        self.elements: list[tuple[str, int, int]] = []
        self.spans: list[list[int]] = []
        self.regions: list[tuple[str, int]] = []    # (kind, number of enclosing content regions)
        self.holds: set[int] = set()                # furniture by hint that holds a content container
        self.open: tuple[int, ...] = ()
        self.silent = 0
        self.links = 0
        self.parts: list[str] = []
        self.link_chars = 0
        self.tags = 0

    def cut(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, min(self.link_chars, len(text)), self.tags, self.open,
                               self.path[-1] if self.path else -1))
        self.parts, self.link_chars, self.tags = [], 0, 0

    def _region(self, tag: str, attrs: dict) -> str | None:
        if tag in CONTENT or attrs.get("role") in ("main", "article"):
            words = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
            return "hint" if tag == "article" and _hinted(words) == "hint" else "content"
        if tag in FURNITURE or attrs.get("role") in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
            return "furniture"
        if tag == "header":  # the header of the page; an article's own header is part of the article
            return None if any(self.regions[r][0] == "content" for r in self.open) else "furniture"
        if tag in BLOCK and tag not in ("html", "body") or tag in ("span", "ins"):
            return _hinted(f"{attrs.get('class') or ''} {attrs.get('id') or ''}")
        return None

    def _end_head(self):
        """Ends an open head whose end tag was left out; what a noscript or template holds stays in it."""
        tags = [t for t, _ in self.stack]
        if "head" in tags and not {"noscript", "template"}.intersection(tags[tags.index("head"):]):
            self._close("head")

    def handle_starttag(self, tag, attrs):
        if self.silent and tag not in HEAD:
            self._end_head()
        if tag in CLOSES_P and any(t == "p" for t, _ in self.stack[-4:]):
            self._close("p", within=4)
        if tag in BLOCK:
            self.cut()
        self.tags += 1
        if tag in VOID:
            return
        region = -1
        kind = self._region(tag, {k: (v or "") for k, v in attrs})
        if kind:
            self.cut()  # the text before an inline region is not part of it
            region = len(self.regions)
            self.regions.append((kind, len(self.open)))
            if kind == "content":
                self.holds.update(r for r in self.open if self.regions[r][0] in ("hint", "part"))
            self.open = (*self.open, region)
        if tag in SILENT:
            self.silent += 1
        if tag == "a":
            self.links += 1
        self.elements.append((tag, self.path[-1] if self.path else -1, region))
        self.spans.append([len(self.lines), -1])
        self.path.append(len(self.elements) - 1)
        self.stack.append((tag, region))

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK:
            self.cut()
        self.tags += 1

    def _pop(self):
        if self.stack[-1][1] >= 0 or self.stack[-1][0] in BLOCK:
            self.cut()
        tag, region = self.stack.pop()
        self.spans[self.path.pop()][1] = len(self.lines)
        if region >= 0:
            self.open = tuple(r for r in self.open if r != region)
        if tag in SILENT:
            self.silent -= 1
        if tag == "a":
            self.links -= 1

    def _close(self, tag, within=None):
        depth = next((i for i, (t, _) in enumerate(reversed(self.stack)) if t == tag), None)
        if depth is None or within is not None and depth >= within:
            return
        if within is None and tag not in BLOCK and any(t in BLOCK for t, _ in self.stack[len(self.stack) - depth:]):
            return  # a stray end of an inline element does not close blocks
        for _ in range(depth + 1):
            self._pop()

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.cut()
        self.tags += 1
        if tag not in VOID:
            self._close(tag)

    def handle_data(self, data):
        if self.silent and self.stack[-1][0] == "head" and data.strip():
            self._end_head()
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.link_chars += len(data.strip())


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    half = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(x)), kernel)[half:half + len(x)]
    return np.convolve(x, kernel)[half:half + len(x)] / weight


def _outside_furniture(p: _Lines) -> np.ndarray:
    """Whether each line lies outside page furniture (see the head of this file)."""
    lines, kinds = p.lines, [k for k, _ in p.regions]
    free = lambda gone: np.array([gone.isdisjoint(r) for *_, r, _ in lines])
    size = [len(t) - link for t, link, *_ in lines]

    def heavy(rows: np.ndarray) -> set[int]:
        """Regions with at least half of the text of ``rows``."""
        weight: dict[int, int] = {}
        for i in np.flatnonzero(rows):
            for r in lines[i][3]:
                weight[r] = weight.get(r, 0) + size[i]
        total = sum(size[i] for i in np.flatnonzero(rows))
        return {r for r, w in weight.items() if total and 2 * w >= total}

    hard = {r for r, k in enumerate(kinds) if k == "furniture"}
    hints = {r for r, k in enumerate(kinds) if k in ("hint", "part")} - p.holds
    outside = free(hard)
    most = heavy(outside)
    hints -= {r for r in most if kinds[r] == "part"}
    content = {r for r, k in enumerate(kinds) if k == "content"}
    good = free(hard | hints)
    if not any(ok and not content.isdisjoint(r) for ok, (*_, r, _) in zip(good, lines)):
        # no other article: hinted ones count, unless they stand in a hinted wrapper
        top = {r for e, (tag, _, r) in enumerate(p.elements) if tag == "article" and r in hints
               and not any(p.elements[x][2] in hints for x in _ancestors(p, p.elements[e][1]))}
        good = free(hard | hints - most - top)
    everything = np.ones(len(lines), bool)
    text = np.array(size) > 0
    for rescue in (lambda: outside, lambda: free(hard - heavy(everything)), lambda: everything):
        if good.any():
            break
        good = rescue()
        good = good if (good & text).any() else np.zeros(len(lines), bool)
    return good


def _ancestors(p: _Lines, e: int):
    """``e`` and the elements around it, innermost first."""
    while e >= 0:
        yield e
        e = p.elements[e][1]


def main_text(html: str | None, sigma: float = 1.0, threshold: float = 0.25) -> str:
    """The main text of one page: its lines joined by a newline; empty without any.

    ``threshold`` is relative to the mean smoothed ratio of the page's lines that carry text."""
    if not html:
        return ""
    p = _Lines()
    p.feed(html)
    p.close()
    p.cut()
    while p.stack:
        p._pop()
    lines = p.lines
    if not lines:
        return ""
    good = _outside_furniture(p)
    ratio = np.array([(len(t) - link) / max(1, tags) for t, link, tags, *_ in lines], float) * good
    flat = smooth(ratio, sigma) if good.any() else ratio
    level = threshold * flat[ratio > 0].mean() if (ratio > 0).any() else 0.0
    above = good & (flat > level)
    if not above.any():
        above = good
    if not above.any():
        return ""
    kinds = [k for k, _ in p.regions]
    named = np.array([any(kinds[r] == "content" for r in rs) for *_, rs, _ in lines])
    linked = good & np.array([2 * link >= len(t) for t, link, *_ in lines])
    core = np.flatnonzero(above & ~linked | good & named)
    if not len(core):
        core = np.flatnonzero(above)
    lo, hi = int(core[0]), int(core[-1])
    # in page order the common ancestor of the first and the last line is that of all between them
    around = set(_ancestors(p, lines[lo][4]))
    up = [e for e in _ancestors(p, lines[hi][4]) if e in around]
    content = [e for e in up if p.elements[e][2] >= 0 and kinds[p.elements[e][2]] == "content"]
    if content:
        lo, hi = p.spans[content[-1]]
    else:
        first, last = p.spans[up[0]] if up else (0, len(lines))
        while lo > first and not linked[lo - 1]:
            lo -= 1
        while hi + 1 < last and not linked[hi + 1]:
            hi += 1
        hi += 1
    return "\n".join(lines[i][0] for i in range(lo, hi) if good[i])


def _extract(batches):
    for b in batches:
        texts = [main_text(h) for h in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row; a null or empty html gives the empty text.
    Repeated rows are extracted alike, other columns are ignored.  Pages are independent of each
    other, so there is no shuffle; a task holds one Arrow batch of pages."""
    kind = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(
        _extract, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
