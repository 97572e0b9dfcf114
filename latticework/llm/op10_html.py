"""Main content of web pages by text-to-tag ratio.

Parser events stream into lines: block-level tags, line breaks and newlines of
the source end a line.  Each line's ratio is its visible characters over its
tags (characters within links count only to the denominator's side: a line of
link text has as many tags as links).  The sequence of ratios is smoothed with
a Gaussian, and a one-dimensional two-means split of the smoothed values gives
the threshold; lines at or above it form the content.  A line's score is its
smoothed value, or twice its own where that is less: a line without text of its
own isn't lifted by its neighbours.  A heading just above a content line goes
with it.

The parser is the standard library's, fed one page at a time without building
a tree.  Script, style, template and comment content never counts.  Text in
nav, footer, aside, button or select counts PENALTY of its ratio, unless the
element holds most of the page's unlinked text.  An end tag ends what is open
within its element; an element that only the page's end would end is taken for
left open by mistake, and neither skips nor penalises what follows.  A link
ends with its own end tag, with the next link, or with the block that it stands
in; one that ends otherwise than by its own tag is taken for left open, and its
text for plain.  A tag or comment that the page cuts off is text, found without
reading the rest of the page again for each.

Defined results: a null page gives null content and counts; an empty page, or
one without visible text, gives empty content; pages whose lines are all alike
keep every line; broken markup is read as the parser reads it; ids may be null
or repeated, each row is read for itself; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

SIGMA, PENALTY = 1.0, 0.1
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
SKIPPED = frozenset(("script", "style", "template", "noscript", "svg", "title", "head"))
BOILERPLATE = frozenset(("nav", "footer", "aside", "button", "select"))
VOID = frozenset(("br", "hr"))
FOLLOWED = (BLOCKS | SKIPPED | BOILERPLATE) - VOID
WHOLE = frozenset(("html", "body"))
_space = re.compile(r"[ \t\r\f\v\n ]+")


class Lines(HTMLParser):
    """Events in, lines out: (text, tags, link characters, is a heading, the outermost boilerplate element that holds it or -1).

    ignored: numbers of the elements that skip and penalise nothing; unclosed: those found to lack an end.
    """

    def __init__(self, ignored: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, int]] = []
        self.text: list[str] = []
        self.tags = self.linked = self.links = self.depth = self.skip = self.number = 0
        self.in_link = False
        self.heading = False
        self.ignored, self.unclosed = ignored, set()
        self.open: list[tuple[str, int]] = []
        self.count: Counter = Counter()
        self.aside: list[int] = []

    def cut(self):
        text = _space.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append((text, self.tags, self.linked, self.heading, self.aside[0] if self.aside else -1))
            self.tags = 0
        self.text, self.linked = [], 0

    def begin(self, tag):
        self.number += 1
        self.open.append((tag, self.number))
        self.count[tag] += 1
        if self.number not in self.ignored:
            self.skip += tag in SKIPPED and tag != "head"
            if tag in BOILERPLATE:
                self.aside.append(self.number)

    def link(self):
        """A link begins, and ends one that was left open; links count with a number below 0."""
        if self.in_link:
            self.unclosed.add(-self.links)
        self.links += 1
        self.in_link, self.depth = -self.links not in self.ignored, len(self.open)

    def end(self, tag):
        """Ends the innermost element of that tag, and what is open within; "" ends all."""
        while self.open if not tag else self.count[tag]:
            t, n = self.open.pop()
            self.count[t] -= 1
            special = t in BOILERPLATE or t in SKIPPED and t != "head"
            if special and n not in self.ignored:
                self.skip -= t in SKIPPED
                if t in BOILERPLATE:
                    self.aside.pop()
                if not tag or tag in WHOLE:
                    self.unclosed.add(n)
            if t == tag:
                break
        if self.in_link and (len(self.open) < self.depth or not tag):
            self.unclosed.add(-self.links)
            self.in_link = False

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.cut()
        self.tags += 1
        if tag == "a":
            self.link()
        elif tag in HEADINGS:
            self.heading = True
        if tag in FOLLOWED:
            self.begin(tag)

    def handle_startendtag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.cut()

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.cut()
        if tag == "a":
            self.in_link = False
        elif tag in HEADINGS:
            self.heading = False
        if tag in FOLLOWED:
            self.end(tag)

    def handle_data(self, data):
        if self.skip:
            return
        first = True
        for part in data.split("\n"):
            if not first:
                self.cut()
            first = False
            self.text.append(part)
            if self.in_link:
                self.linked += len(part)


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian average over neighbours; at the ends over those there are."""
    r = max(1, math.ceil(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(values, k, "full")[r : r + len(values)] / np.convolve(np.ones(len(values)), k, "full")[r : r + len(values)]


def threshold(values: np.ndarray) -> float:
    """Border of the two clusters that leave the least variance within, over all splits of the sorted values."""
    v = np.sort(values)
    n = len(v)
    if n < 2 or v[0] == v[-1]:
        return float(v[0]) if n else 0.0
    c, s = np.cumsum(v), np.cumsum(v * v)
    i = np.arange(1, n)
    within = s[:-1] - c[:-1] ** 2 / i + (s[-1] - s[:-1]) - (c[-1] - c[:-1]) ** 2 / (n - i)
    within[v[1:] == v[:-1]] = np.inf
    at = int(within.argmin())
    return float((v[at] + v[at + 1]) / 2)


def parsed(html: str, ignored: frozenset[int] = frozenset()) -> Lines:
    p = Lines(ignored)
    closed = max(html.rfind("-->"), html.rfind("--!>"))
    if (at := html.find("<!--", max(0, closed))) >= 0:
        html = html[:at] + html[at:].replace("<!--", "&lt;!--")
    whole = html.rfind(">") + 1
    p.feed(html[:whole])
    p.close()
    if not p.cdata_elem:
        p.handle_data(unescape(html[whole:]))
    p.cut()
    p.end("")
    return p


def extract(html: str) -> tuple[str, int, int]:
    """(content, lines, content lines)."""
    p = parsed(html)
    if p.unclosed:
        p = parsed(html, frozenset(p.unclosed))
    lines = p.lines
    if not lines:
        return "", 0, 0
    held: Counter = Counter()
    for t, _, k, _, n in lines:
        held[n] += len(t) - min(k, len(t))
    most = held.total() / 2
    low = [n >= 0 and held[n] <= most for *_, n in lines]
    ratio = np.array([(PENALTY if x else 1) * (len(t) - min(k, len(t))) / max(1, g) for (t, g, k, *_), x in zip(lines, low)])
    dense = np.round(smoothed(np.log1p(ratio)), 9)  # else equal lines part by rounding
    # the smoothed score of a line without text of its own stays low, whatever stands next to it
    score = np.minimum(dense, 2 * np.log1p(ratio))
    keep = score >= min(threshold(score), score.max())
    for i in range(len(lines) - 2, -1, -1):
        if lines[i][3] and not low[i] and keep[i + 1]:
            keep[i] = True
    return "\n".join(x[0] for x, k in zip(lines, keep) if k), len(lines), int(keep.sum())


def contents(pages: DataFrame) -> DataFrame:
    """(page_id, content, n_lines, content_lines) of every page."""
    schema = pa.schema([("page_id", pa.int64()), ("content", pa.string()), ("n_lines", pa.int32()), ("content_lines", pa.int32())])

    def run(batches):
        for b in batches:
            found = [(None, None, None) if x is None else extract(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[i] for f in found], schema.field(i + 1).type) for i in range(3))], schema=schema)

    return arrow_map(pages.select(F.col("page_id").cast("long").alias("page_id"), "html"), run, "page_id long, content string, n_lines int, content_lines int")
