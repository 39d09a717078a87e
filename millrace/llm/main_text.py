"""The main text of a page by text-to-tag ratios.

The standard library's parser streams events; block elements cut them into lines.  Each line
has the ratio of its text, links counted out, to its tags, times the weight of its place: none in
an element that names itself as something else, little outside the page's ``article`` or ``main``
elements if it has such.  The ratios are smoothed by a Gaussian over neighbouring lines.  Two means
over smoothed ratio and its change, one of them held at the origin, part the lines: those nearer to
the other mean are content.  A region of content grows over neighbours, short paragraphs and headings,
whose smoothed ratio is not below a share of that mean's, and takes in what lies between.

Defined cases: a null or empty page, or one without text, gives an empty text; an unclosed
element ends where HTML ends it; an unfinished tag at the end is text; characters are counted as code
points; very long pages take time in proportion to their length; repeated rows are rows of their own
and an empty table gives no rows; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.rows import add_struct, texts_of

SIGMA = 1.0
RADIUS = 3
OUTSIDE = 0.1  # weight of lines outside article and main, where there are such
GROWTH = 0.02  # share of the content's mean ratio that a neighbour needs
INSIDE_GROWTH = 0.0  # the same within an article or main element
GAP = 2
TURNS = 50

# Element names of HTML by their role, and words that name parts of a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var".split()
)
HIDDEN = set("head script style noscript template title textarea option iframe object svg canvas audio video map".split())
NEVER = set("nav footer aside form button select input menu dialog".split())
WORDS = set(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disclaimer disqus footer gdpr masthead menu modal nav navbar navigation "
    "newsletter notice notices notification pager pagination popup promo promotion promoted related "
    "replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe "
    "toolbar widget widgets".split()
)
ROLES = set("banner navigation complementary contentinfo search form alert dialog menu menubar".split())
LAYOUT = set("with has no without".split())


def _noise(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether an element's class, id or role names a part that is not the article."""
    if tag in ("html", "body", "article", "main") and not any(
        (v or "").lower().startswith("comment") for k, v in attrs if k in ("class", "id")
    ):
        return False
    for name, value in attrs:
        value = (value or "").lower()
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id"):
            for one in value.split():
                parts = re.split(r"[^a-z]+", one)
                if not LAYOUT & set(parts) and WORDS & {parts[0], parts[-1]}:
                    return True
    return False


@dataclass(frozen=True)
class Line:
    """A line's text, the tags since the line before, its characters within links, and where it lies."""

    text: str
    tags: int
    linked: int
    named: bool  # in an element that names itself as something else
    home: int  # number of its article or main element, or 0


class Lines(HTMLParser):
    """Collects the lines of a page.

    Open elements are counted by name within the innermost block, so a closing tag that closes
    nothing costs no search, and every element is opened and closed once.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self._open: list[str] = []
        self._names: Counter[str] = Counter()  # of all open elements
        self._blocks: list[tuple[int, Counter[str]]] = [(-1, Counter())]  # depth, inline elements within
        self._hidden: list[int] = []  # depths of elements that show no text
        self._other: list[int] = []  # depths of elements that name themselves as something else
        self._homes: list[tuple[int, int]] = []  # depth and number of article and main
        self._made = 0
        self._parts: list[str] = []
        self._tags = self._linked = 0

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                home = self._homes[-1][1] if self._homes else 0
                self.lines.append(Line(text, self._tags, self._linked, bool(self._other), home))
        self._parts, self._tags, self._linked = [], 0, 0

    def _shrink(self, depth: int) -> None:
        """Close all elements from ``depth`` on."""
        while len(self._open) > depth:
            name = self._open.pop()
            self._names[name] -= 1
            if self._blocks[-1][0] == len(self._open):
                self._blocks.pop()
            else:
                self._blocks[-1][1][name] -= 1
        for depths in (self._hidden, self._other):
            while depths and depths[-1] >= depth:
                depths.pop()
        while self._homes and self._homes[-1][0] >= depth:
            self._homes.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE and tag not in VOID or tag == "hr":
            self._flush()
            self._close_implied(tag)
        self._tags += 1
        if tag == "br":
            self._parts.append(" ")
        if tag in VOID:
            return
        depth = len(self._open)
        self._open.append(tag)
        self._names[tag] += 1
        if tag in INLINE:
            self._blocks[-1][1][tag] += 1
        else:
            self._blocks.append((depth, Counter()))
        if tag in HIDDEN:
            self._hidden.append(depth)
        elif tag in NEVER or tag == "header" and not self._homes or attrs and _noise(tag, attrs):
            self._other.append(depth)
        elif tag in ("article", "main"):
            self._made += 1
            self._homes.append((depth, self._made))

    def _close_implied(self, tag: str) -> None:
        """A block ends an open paragraph, an item an open item."""
        depth = self._blocks[-1][0]
        enders = ("p", tag) if tag in ("li", "dt", "dd", "tr", "td", "th", "option") else ("p",)
        if depth >= 0 and self._open[depth] in enders:
            self._shrink(depth)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE and tag not in VOID:
            self._flush()
        self._tags += 1
        # An inline element is closed within its block only.
        known = self._blocks[-1][1] if tag in INLINE else self._names
        if known[tag] > 0:
            depth = len(self._open) - 1
            while self._open[depth] != tag:
                depth -= 1
            self._shrink(depth)

    def handle_data(self, data: str) -> None:
        if not self._hidden:
            self._parts.append(data)
            if self._names["a"] > 0:
                self._linked += len(data.strip())

    def read(self, html: str) -> list[Line]:
        """The lines of a page; an unfinished tag at its end is taken as text at once."""
        end = html.rfind(">") + 1
        self.feed(html[:end])
        self.close()
        self.handle_data(unescape(html[end:]))
        self._flush()
        return self.lines


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """The ratios under a Gaussian window; beyond the ends stands nothing."""
    steps = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-(steps**2) / (2 * SIGMA**2))
    kernel /= kernel.sum()
    return np.convolve(np.pad(ratios, RADIUS), kernel, "valid")


def core(ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Lines nearer to the content's mean than to the origin, and that mean's ratio.

    The points are the smoothed ratios with the size of their change from line to line; the mean
    starts at the greatest ratio and moves to the middle of its lines until it stays.
    """
    change = np.abs(np.diff(ratios, append=0.0))
    points = np.stack([ratios, change], axis=1)
    mean = points[ratios.argmax()]
    near = np.zeros(len(ratios), bool)
    for _ in range(TURNS):
        # Nearer to the mean than to the origin.
        now = points @ mean > mean @ mean / 2
        if not now.any() or (now == near).all():
            break
        near, mean = now, points[now].mean(axis=0)
    return near, float(mean[0])


def content_lines(lines: list[Line]) -> np.ndarray:
    """Which lines are the article's."""
    size = np.array([len(line.text) for line in lines], float)
    linked = np.minimum(np.array([line.linked for line in lines], float), size)
    tags = np.maximum(np.array([line.tags for line in lines], float), 1)
    home = np.array([line.home for line in lines])
    named = np.array([line.named for line in lines])
    weight = np.where((home > 0) | (not home.any()), 1.0, OUTSIDE) * ~named
    ratios = smoothed((size - linked) / tags * weight) * weight
    near, mean = core(ratios)
    vouched = np.isin(home, home[near & (home > 0)]) & (home > 0)
    least = np.where(vouched, INSIDE_GROWTH, GROWTH) * mean
    fits = (ratios > least) & ((2 * linked <= size) | vouched)
    return _grown(near & fits, fits, weight > 0)


def _grown(near: np.ndarray, fits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Runs of lines that fit, with a line of the core in each; up to ``GAP`` others within a run come
    along, and lines that do not count neither end a run nor belong to it."""
    out = np.zeros(len(near), bool)
    run, cored, gap = [], False, []
    for i in [*np.flatnonzero(counts).tolist(), None]:
        if i is not None and fits[i]:
            run, gap, cored = run + gap + [i] if gap else run, [], cored or bool(near[i])
            if not run or run[-1] != i:
                run.append(i)
            continue
        if i is not None and run and len(gap) < GAP:
            gap.append(i)
            continue
        if cored:
            out[run] = True
        run, cored, gap = [], False, []
    return out


def main_text(html: str) -> str:
    """The article of a page, its blocks joined by one space."""
    lines = Lines().read(html)
    chosen = content_lines(lines) if lines else np.empty(0, bool)
    return " ".join(line.text for line, use in zip(lines, chosen.tolist()) if use)


def extract(pages: DataFrame) -> DataFrame:
    """``row`` (the columns of ``pages``, among them ``html``) and ``out``: ``text``."""

    def work(rows: pa.RecordBatch) -> list[dict]:
        return [{"text": main_text(html)} for html in texts_of(rows.column("html"))]

    return add_struct(pages, work, T.StructType.fromDDL("text string"))


def report(found: DataFrame) -> DataFrame:
    return found.select(
        "row.page_id", "row.url", "out.text", F.char_length("out.text").cast("bigint").alias("n_chars")
    )
