"""Main text of web pages.

The standard library's parser sends events; block elements cut the page into lines. A line has a text-to-tag ratio:
its characters over the tags since the line before. The ratios are smoothed by a Gaussian over neighbouring lines and
clustered by a threshold between two means; the lines above it mark where the content is. The content region is the
element that holds most of the marked text, and all its lines are kept but those inside parts that are never content
(menus, adverts, forms, comments ...), told by their element or by a word of their class, id or role.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tablewright.llm.common import ship

#: Elements without content of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a line where they begin and end.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul br title option".split()
)
#: Elements that are never part of the main text.
NEVER = frozenset(
    "head script style noscript template nav footer aside form button select option textarea input label fieldset iframe object embed applet svg math"
    " canvas audio video map dialog menu menuitem title".split()
)
#: Words of a class, id or role that tell the same.
NEVER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments commentlist disqus respond"
    " cookie cookies consent gdpr notice notices notification alert popup modal overlay menu menus nav navbar navigation topnav subnav sidebar"
    " sidenav rail widget widgets footer masthead header topbar toolbar share sharing social related recommended recommendations promo promoted"
    " promotion sponsor sponsored subscribe subscription newsletter signup login search pagination pager skip skiplink copyright legal disclaimer"
    " contentinfo complementary banners reactions replies reply".split()
)
#: Elements that can be a part of the page by themselves.
PART = frozenset("body center div section td main article blockquote details".split())
#: A paragraph that is still open ends where one of these begins.
ENDS_P = BLOCK - {"br", "body", "html"}
WORD = re.compile(r"[a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Page(HTMLParser):
    """Lines of a page: (text, tags before it, link characters, path of open elements)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []  # element, number, whether it hides what it holds
        self.names: list[str] = []  # of all elements by number
        self.lines: list[tuple[str, int, int, tuple[int, ...]]] = []
        self.text: list[str] = []
        self.tags = self.linked = self.hidden = self.links = 0

    def end_line(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            self.text = []
            if line:
                self.lines.append((line, self.tags, self.linked, tuple(n for _, n, _ in self.open)))
                self.tags = 0
            self.linked = 0

    def pop_to(self, at: int) -> None:
        while len(self.open) > at:
            tag, _, hides = self.open.pop()
            self.hidden -= hides
            self.links -= tag == "a"

    def hides(self, tag: str, attributes: list) -> bool:
        if tag in NEVER:
            return True
        if tag == "header" and not any(t in ("article", "main") for t, _, _ in self.open):
            return True
        if tag in ("html", "body", "article", "main"):
            return False
        for name, value in attributes:
            if name in ("class", "id", "role") and value:
                if not NEVER_WORDS.isdisjoint(WORD.findall(CAMEL.sub(" ", value).lower())):
                    return True
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            elif name == "style" and value and re.search(r"display\s*:\s*none", value):
                return True
        return False

    def handle_starttag(self, tag: str, attributes: list) -> None:
        if tag in BLOCK:
            self.end_line()
            if tag in ENDS_P and any(t == "p" for t, _, _ in self.open):
                self.pop_to(max(i for i, (t, _, _) in enumerate(self.open) if t == "p"))
            if tag in ("article", "main", "body") and self.hidden:  # a part that was never closed
                self.pop_to(min(i for i, (_, _, h) in enumerate(self.open) if h))
        self.tags += 1
        if tag in VOID:
            return
        hides = self.hides(tag, attributes)
        self.names.append(tag)
        self.open.append((tag, len(self.names) - 1, hides))
        self.hidden += hides
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attributes: list) -> None:
        self.handle_starttag(tag, attributes)  # HTML takes <div/> for <div>

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.pop_to(i)
                return

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())

    def close(self) -> None:
        super().close()
        self.end_line()


def marked(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Which lines have a high ratio, after smoothing: above the threshold between two means that repeated averaging finds."""
    reach = max(1, round(3 * sigma))
    weights = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    smooth = np.convolve(np.pad(ratios, reach, mode="edge"), weights / weights.sum(), mode="valid")
    threshold = smooth.mean()
    for _ in range(50):
        high = smooth > threshold
        if high.all() or not high.any():
            return np.ones(len(ratios), bool)
        new = (smooth[high].mean() + smooth[~high].mean()) / 2
        if abs(new - threshold) < 1e-9:
            break
        threshold = new
    return smooth > threshold


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The main text: blocks in page order, joined by one space. NULL, empty or nothing but markup: empty."""
    if not html:
        return ""
    page = Page()
    page.feed(html)
    page.close()
    lines = page.lines
    if not lines:
        return ""
    size = np.array([len(line[0]) for line in lines], float)
    high = marked(size / np.maximum(1, [line[1] for line in lines]), sigma)
    mass: dict[int, float] = {}
    for own, is_high, (_, _, _, path) in zip(size, high, lines):
        for n in path:
            mass[n] = mass.get(n, 0.0) + own * is_high
    total = float(size[high].sum())
    articles = [n for n in mass if page.names[n] == "article" and mass[n] > 0]
    if len(articles) > 1 and max(mass[n] for n in articles) < 0.6 * total:
        articles = []
    mains = [n for n in mass if page.names[n] == "main" and mass[n] > 0]
    if articles or mains:
        region = max(articles or mains, key=lambda n: (mass[n], -n))
    else:  # the innermost part of the page that holds nearly all of the marked text, and more than one line of it all
        lines_of = Counter(n for _, _, _, path in lines for n in path)
        parts = (n for n in mass if page.names[n] in PART and mass[n] >= 0.9 * total and lines_of[n] > 1)
        region = max(parts, default=None)
    kept = []
    for (text, _, linked, path), own in zip(lines, size):
        if region is not None and region not in path:
            continue
        menu = linked >= 0.8 * len(text.replace(" ", "")) and any(page.names[n] in ("li", "ul", "ol") for n in path)
        if not (menu and linked):
            kept.append(text)
    return " ".join(kept)


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """Adds `into` (replaced if there): the main text of each whole page; empty if there is none. No shuffle."""
    ship(pages.sparkSession)
    kept = [f for f in pages.schema.fields if f.name != into]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                made = pa.array([main_text(v) for v in part.column(part.schema.get_field_index(html)).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), made], names=[*names, into])

    return pages.mapInArrow(run, T.StructType([*kept, T.StructField(into, T.StringType())]))
