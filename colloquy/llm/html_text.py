"""Main text of HTML pages.

The standard library's parser streams events; they become lines (the text of one block element) with the number of tags
around them. The ratio of text to tags per line is smoothed by a Gaussian and split into two clusters by a threshold. The upper
cluster's lines say which regions of the page are content: the articles that hold such lines or, on a page where no article does, the
stretch from the title or the first to the last block of the elements that directly hold them. What the regions hold stays, but for runs of lines that
are links alone: such a run is a menu if it is in the lower cluster as a whole, whatever its elements are called and wherever it stands. Structure is a feature
(lines of articles count double) and a veto on menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
comments.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame

from colloquy.llm.arrow import map_columns

# Fixed lists of the format.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head title script style noscript template nav footer aside form button select textarea input label fieldset menu dialog iframe svg object".split())
INLINE_BREAKS = frozenset(["br", "wbr"])
#: Words that mark what is no content, as a name or part of a name in class, id or role; the second list holds outside articles only.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices newsletter subscribe "
    "subscription nav navbar navigation menu breadcrumb breadcrumbs sidebar footer comment comments disqus reply replies discussion share sharing social related popup "
    "modal login signin signup search toolbar copyright widget pagination pager contentinfo complementary alert".split()
)
OUTSIDE = frozenset("header masthead topbar".split())
#: Names with such a part at their start or end say something of the element that they stand on, e.g. has-sidebar or comments-open.
STATES = frozenset("has have no not non with without is are show hide hidden enable enabled disable disabled open closed on off page results allowed active single".split())
#: Elements that no name marks, marks that hold however long the element is, and elements that lines belong to.
FRAMES, LASTING = frozenset(["html", "body", "main", "article"]), frozenset("comment comments disqus reply replies discussion".split())
CONTAINERS = frozenset(["html", "body", "main", "article", "section", "div", "center"])
SPACE = re.compile(r"[\s]+")
#: Standard deviation of the smoothing, in lines.
SIGMA = 1.0
#: What a line of an article counts, against 1 for others.
ARTICLE = 2.0


@dataclass
class Line:
    text: str
    tags: int
    article: int  # the outermost article or main element; 0 outside
    holder: int  # the nearest container
    never: bool  # in an element of a kind that is no content
    marks: tuple[int, ...]  # the elements around it that their names mark
    title: bool  # an h1
    links: bool  # all of the text is in links

    @property
    def ratio(self) -> float:
        return len(self.text) / max(1, self.tags) * (ARTICLE if self.article else 1.0)


@dataclass
class Open:
    tag: str
    article: int = 0
    holder: int = 0
    never: bool = False
    marks: tuple[int, ...] = ()


def marked(names: str, inside: bool) -> set[str]:
    """The marks among the names of an element; `inside`: it stands in an article."""
    found = set()
    for name in names.lower().split():
        parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
        own = set(parts) & (MARKS if inside else MARKS | OUTSIDE)
        if own and not (len(parts) > 1 and (parts[0] in STATES or parts[-1] in STATES)):
            found |= own
    return found


@dataclass
class Reader(HTMLParser):
    """Events to lines."""

    lines: list[Line] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.counts = [Open("")], Counter()
        self.parts: list[str] = []
        self.tags = self.made = 0
        self.said = self.linked = 0  # letters so far, and those in links
        self.link = False
        self.lasting: set[int] = set()

    @property
    def top(self) -> Open:
        return self.open[-1]

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            top = self.top
            self.lines.append(Line(text, self.tags, top.article, top.holder, top.never, top.marks, top.tag == "h1", self.said == self.linked))
            self.tags = 0
        self.parts.clear()
        self.said = self.linked = 0

    def pop(self) -> None:
        self.counts[self.open.pop().tag] -= 1

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link = True
        if tag in BLOCKS:
            self.flush()
            self.link = False  # a link that is never closed ends with its block
            if tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "div", "section", "article", "main", "ul", "ol", "table") and self.top.tag == "p":
                self.pop()
            if tag == "li" and self.top.tag == "li":
                self.pop()
        elif tag in INLINE_BREAKS:
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        top = self.top
        never = top.never or tag in NEVER or (tag == "header" and not top.article)
        marks = top.marks
        if tag not in FRAMES and (names := " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)) and (found := marked(names, bool(top.article))):
            self.made += 1
            marks = (*marks, self.made)
            if found & LASTING:
                self.lasting.add(self.made)
        other = never != top.never or marks != top.marks
        if other and tag not in BLOCKS:
            self.flush()
        if tag in BLOCKS or other:
            article, holder = top.article, top.holder
            if tag in CONTAINERS:
                self.made += 1
                holder = self.made
                if tag in ("article", "main") and not never and not article:
                    article = holder
            self.open.append(Open(tag, article, holder, never, marks))
            self.counts[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.link = False
        if self.counts[tag]:
            self.flush()
            while self.top.tag != tag:
                self.pop()
            self.pop()
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        self.parts.append(data)
        letters = len(data.strip())
        self.said += letters
        if self.link:
            self.linked += letters

    def content(self) -> np.ndarray:
        """Which lines nothing marks. A marked element that holds over half of the page's text is no menu or notice: its mark
        falls, unless the mark is one of comments or an unmarked article stands beside it."""
        size, held = 0, Counter()
        articles = False
        for x in self.lines:
            if not x.never:
                size += len(x.text)
                articles |= bool(x.article) and not x.marks
                for m in x.marks:
                    held[m] += len(x.text)
        fallen = set() if articles else {m for m, n in held.items() if 2 * n > size and m not in self.lasting}
        return np.array([not x.never and fallen.issuperset(x.marks) for x in self.lines], bool)


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends the weights that fall outside are left out."""
    reach = max(1, round(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(values, weights, "same") if len(values) >= len(weights) else np.convolve(values, weights)[reach : reach + len(values)]
    ones = np.convolve(np.ones(len(values)), weights)[reach : reach + len(values)]
    return total / ones


def threshold(values: np.ndarray) -> float:
    """The border between two clusters: their means' midpoint, moved until it stays."""
    border = float(values.mean())
    for _ in range(100):
        low, high = values[values <= border], values[values > border]
        if not len(low) or not len(high):
            return float(values.min()) - 1.0
        new = (float(low.mean()) + float(high.mean())) / 2
        if abs(new - border) < 1e-9:
            break
        border = new
    return border


def without_menus(lines: list[Line], fit: np.ndarray, values: np.ndarray, border: float) -> np.ndarray:
    """The fit lines without runs of links whose smoothed ratios are below the border on the whole."""
    out, run = fit.copy(), []
    for i in [*np.flatnonzero(fit).tolist(), None]:
        if i is not None and lines[i].links and (not run or lines[i].holder == lines[run[-1]].holder):
            run.append(i)
            continue
        if len(run) > 1 and float(values[run].mean()) <= border:
            out[run] = False
        run = [i] if i is not None and lines[i].links else []
    return out


def main_text(html: str | None) -> str:
    """Text of the content blocks, joined by blank lines; empty if the page has none."""
    reader = Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    lines = reader.lines
    fit = reader.content()
    if not fit.any():
        return ""
    values = smoothed(np.array([x.ratio if f else 0.0 for x, f in zip(lines, fit)]))
    border = threshold(values[fit])
    high = fit & (values > border)
    fit = without_menus(lines, fit, values, border)
    high &= fit
    articles = {x.article for x, f, h in zip(lines, fit, high) if x.article and f and (h or x.ratio > border)}  # a short one may be smoothed away
    if articles:
        return "\n\n".join(x.text for x, f in zip(lines, fit) if f and x.article in articles)
    holders = {x.holder for x, h in zip(lines, high) if h}
    own = [i for i, (x, f) in enumerate(zip(lines, fit)) if f and x.holder in holders]
    if not own:
        return ""
    first = max((i for i in range(own[0]) if fit[i] and lines[i].title), default=own[0])  # a title may stand in an element of its own
    return "\n\n".join(lines[i].text for i in range(first, own[-1] + 1) if fit[i])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of whole pages.

    Null and empty pages, and pages without content, have empty text; an empty table gives no rows. Of several articles all that hold lines of the upper cluster
    are kept, in page order. Rows are independent: repeated rows give a row each, and further columns don't matter.
    """

    def run(ids, urls, htmls):
        texts = [main_text(h) for h in htmls]
        return {"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}

    kind = pages.schema[id_col].dataType.simpleString()
    return map_columns(pages, {"page_id": id_col, "url": url_col, "html": html_col}, run, f"page_id {kind}, url string, text string, n_chars long")
