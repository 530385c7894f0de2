"""Main text of HTML pages by text-to-tag ratios.

The standard library's parser streams a page's events into lines (blocks of text) with their tag
counts. The ratio of text to tags per line is smoothed with a Gaussian and thresholded into content
and boilerplate clusters; the content lines elect the region of the page that holds them, and the
region's lines are the text, without the parts whose markup says that they are something else.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element and attribute names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
REGIONS = frozenset("article main section div td body html blockquote center".split())
NEVER = frozenset("head title script style noscript template nav aside footer form button select textarea iframe object svg math audio video canvas dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words in class and id attributes that name boilerplate.
LABELS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments disqus replies reply respond share sharing social related recommended recommendations newsletter subscribe subscription signup signin login popup modal overlay pagination pager toolbar skip copyright legal".split()
)
ENDS_P = BLOCKS - {"option", "optgroup", "legend", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"}
ENDS_SAME = frozenset("li dd dt tr td th option p".split())

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that hold running text.
TEXT = HEADINGS | frozenset("p li dd dt blockquote pre td th caption figcaption summary address".split())

_WORD = re.compile(r"[a-z]+|\d+")
_SENTENCE = re.compile(r"[.!?…:;。！？][\"'»”’)\]]*$")
_RIGHTS = re.compile(r"©|\(c\)|copyright|all rights", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Line:
    """A block of text: the tags since the one before, linked characters, the region it stands in, the
    nearest block element, and what the elements around it say of it."""

    __slots__ = ("block", "excluded", "inside", "label", "links", "region", "tags", "text")

    def __init__(self, text: str, tags: int, links: int, region: int, block: str, excluded: bool, label: int, inside: bool) -> None:
        self.text, self.tags, self.links, self.region = text, tags, links, region
        self.block, self.excluded, self.label, self.inside = block, excluded, label, inside

    @property
    def plain(self) -> int:
        """Characters that are not linked."""
        return max(0, len(self.text) - self.links)

    @property
    def linked(self) -> bool:
        return 2 * self.links >= len(self.text)


class _Lines(HTMLParser):
    """The lines of a page and the tree of its regions, in one pass: every element is opened and closed
    once, whatever its markup."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parents: list[int] = [-1]  # of regions, which are numbered as they open; 0 is the page
        self.kinds: list[str] = ["html"]
        #: Of elements labelled by class or id, the labelled ones around them; 0 is the page.
        self.labels: list[int] = [-1]
        #: Open elements: tag, region, excluded, inside an article or main element, labelled.
        self.open: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, 0)]
        #: Places of the block elements among them, and how many there are of each tag.
        self.blocks: list[int] = [0]
        self.count: Counter[str] = Counter()
        self.text: list[str] = []
        self.tags, self.links = 0, 0
        #: Place among the open elements of the outermost one that an attribute other than class or id excludes.
        self.inside_labelled = 0
        self.searched: tuple[str, int] = ("", -1)

    # The standard parser goes back to the character after an unfinished tag, comment or declaration,
    # which takes quadratic time where there are many. Here they run to the end of the page, as in
    # browsers.

    def parse_starttag(self, i: int) -> int:
        return super().parse_starttag(i) if self.closed_after(i) else len(self.rawdata)

    def parse_endtag(self, i: int) -> int:
        return super().parse_endtag(i) if self.closed_after(i) else len(self.rawdata)

    def parse_comment(self, i: int, report: int = 1) -> int:
        end = self.rawdata.find("-->", i + 2)
        return len(self.rawdata) if end < 0 else end + 3

    def parse_html_declaration(self, i: int) -> int:
        return self.rawdata.find(">", i) + 1 if self.closed_after(i) else len(self.rawdata)

    parse_pi = parse_html_declaration

    def closed_after(self, i: int) -> bool:
        if self.searched[0] is not self.rawdata:
            self.searched = self.rawdata, self.rawdata.rfind(">")
        return self.searched[1] > i

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            _, region, out, inside, label = self.open[-1]
            self.lines.append(Line(text, self.tags, self.links, region, self.open[self.blocks[-1]][0], out, label, inside))
            self.tags = self.links = 0
        self.text = []

    def boilerplate(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in NEVER:
            return True
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if name == "role" and (value or "").lower() in ROLES:
                return True
            if name == "style" and _HIDDEN.search(value or ""):
                return True
        return False

    def labelled(self, tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> bool:
        for name, value in attrs:
            if name in ("class", "id") and tag not in ("html", "body"):
                words = _WORD.findall((value or "").lower())
                if not LABELS.isdisjoint(words) or ("header" in words and not inside):
                    return True
        return False

    def close_to(self, at: int) -> None:
        if self.inside_labelled >= at:
            self.inside_labelled = 0
        for tag, *_ in self.open[at:]:
            self.count[tag] -= 1
        del self.open[at:]
        while self.blocks[-1] >= at:
            self.blocks.pop()

    def close_implied(self, tag: str) -> None:
        """Close what a block's start tag ends: a paragraph, or the last item of the same kind."""
        for at in reversed(self.blocks[-2:]):
            name = self.open[at][0]
            if at and ((name == "p" and tag in ENDS_P) or (name == tag and tag in ENDS_SAME)):
                self.close_to(at)
                return
            if name != "p":
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
            self.close_implied(tag)
        elif tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        _, region, out, inside, label = self.open[-1]
        main = tag in ("article", "main")
        excluded = self.boilerplate(tag, attrs) or (tag == "header" and not inside)
        if main and not self.inside_labelled:
            out = False  # a form or an unclosed menu around the article
        out = out or excluded
        if self.labelled(tag, attrs, inside):
            self.labels.append(label)
            label = len(self.labels) - 1
        if excluded and tag not in NEVER and not self.inside_labelled:
            self.inside_labelled = len(self.open)
        if tag in REGIONS:
            self.parents.append(region)
            self.kinds.append(tag)
            region = len(self.parents) - 1
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.count[tag] += 1
        self.open.append((tag, region, out, inside or main, label))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "math"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if self.count[tag]:
            at = len(self.open) - 1
            while self.open[at][0] != tag:
                at -= 1
            self.close_to(at)

    def handle_data(self, data: str) -> None:
        if self.open[-1][0] in ("script", "style"):
            return
        self.text.append(data)
        if self.count["a"]:
            self.links += len(data.strip())


def smoothed(ratios: np.ndarray, radius: int = 2) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines, with a standard deviation of half the radius;
    at the ends the weights inside the page are scaled to one."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / (radius / 2)) ** 2)
    return np.convolve(ratios, kernel)[radius : radius + len(ratios)] / np.convolve(np.ones(len(ratios)), kernel)[radius : radius + len(ratios)]


def content_lines(lengths: np.ndarray, tags: np.ndarray, marked: np.ndarray | None = None) -> np.ndarray:
    """Which lines fall into the content cluster: smoothed text-to-tag ratio of at least the
    threshold, the ratios' standard deviation, but no more than their mean; half of that is enough
    for a line that reaches the threshold itself, and where the author marks an article. A run of
    content lines begins and ends with lines that reach the threshold themselves, not by what
    smoothing lends them."""
    own = lengths / np.maximum(tags, 1)
    ratios = smoothed(own)
    threshold = np.full(len(own), min(ratios.std(), ratios.mean()))
    if marked is not None:
        threshold[marked] /= 2
    content = (ratios >= threshold) | ((own >= threshold) & (ratios >= threshold / 2))
    edges = np.flatnonzero(np.diff(np.concatenate(([False], content, [False])).astype(np.int8)))
    for begin, end in zip(edges[::2], edges[1::2], strict=True):
        strong = begin + np.flatnonzero(own[begin:end] >= threshold[begin:end])
        first, last = (strong[0], strong[-1] + 1) if len(strong) else (end, end)
        content[begin:first] = content[last:end] = False
    return content


def unlabelled(lines: list[Line], labels: list[int]) -> list[Line]:
    """The lines outside elements labelled as boilerplate by class or id. A label on a wrapper doesn't
    count: while no article or main has text, an element that holds one with text, or over half of
    the unlinked text, is let in, the outermost first. If no line is left, all are."""
    text, marked = [0] * len(labels), [0] * len(labels)
    for x in lines:
        text[x.label] += x.plain
        marked[x.label] += x.inside * x.plain
    own = list(marked)
    for i in range(len(labels) - 1, 0, -1):
        text[labels[i]] += text[i]
        marked[labels[i]] += marked[i]
    let_in, found = [True] * len(labels), own[0] > 0
    for i in range(1, len(labels)):
        let_in[i] = let_in[labels[i]] and not found and (marked[i] > 0 or 2 * text[i] > text[0])
        found = found or (let_in[i] and own[i] > 0)
    return [x for x in lines if let_in[x.label]] or lines


class Regions:
    """The regions of a page with the unlinked text of the content lines in them."""

    def __init__(self, parents: list[int], kinds: list[str], lines: list[Line], content: np.ndarray) -> None:
        self.parents, self.kinds = parents, kinds
        self.last = list(range(len(parents)))  # the last region inside each: they are numbered as they open
        self.mass = [0.0] * len(parents)
        for x, ok in zip(lines, content, strict=True):
            if ok:
                self.mass[x.region] += x.plain + 1e-9
        self.heaviest = [0] * len(parents)  # the heaviest region directly inside each
        for i in range(len(parents) - 1, 0, -1):
            up = parents[i]
            self.mass[up] += self.mass[i]
            self.last[up] = max(self.last[up], self.last[i])
            if not self.heaviest[up] or self.mass[i] >= self.mass[self.heaviest[up]]:
                self.heaviest[up] = i

    def holds(self, outer: int, inner: int) -> bool:
        return outer <= inner <= self.last[outer]

    def elected(self) -> tuple[list[int], bool]:
        """The regions that hold the content, and whether the author marked them as article or main: the
        smallest region with four fifths of the content, widened to the article around it, or
        narrowed to the articles inside it if they have half of it."""
        region = 0
        while (inner := self.heaviest[region]) and self.mass[inner] >= 0.8 * self.mass[0] and self.mass[inner] > 0:
            region = inner
        up = region
        while up > 0 and self.kinds[up] not in ("article", "main"):
            up = self.parents[up]
        if up > 0:
            return [up], True
        outermost: list[int] = []
        for i in range(region, self.last[region] + 1):
            if self.kinds[i] in ("article", "main") and self.mass[i] > 0 and not (outermost and self.holds(outermost[-1], i)):
                outermost.append(i)
        if outermost and 2 * sum(self.mass[i] for i in outermost) >= self.mass[region]:
            return outermost, True
        return [region], False


def _heading(lines: list[Line], first: int) -> int:
    """The first line, with the headings that lead to it and what stands between, as far as neither
    menus nor other blocks than text come in."""
    start = first
    for at in range(first - 1, max(-1, first - 6), -1):
        if lines[at].linked or lines[at].block not in TEXT:
            break
        if lines[at].block in HEADINGS:
            start = at
    return start


def _ending(lines: list[Line], last: int) -> int:
    """The last line, with the short paragraphs that follow it in the same region."""
    while last + 1 < len(lines):
        x = lines[last + 1]
        if x.linked or x.block not in TEXT or x.region != lines[last].region or not _SENTENCE.search(x.text) or _RIGHTS.match(x.text):
            break
        last += 1
    return last


def main_lines(lines: list[Line], parents: list[int], kinds: list[str]) -> list[Line]:
    """The lines of the main text: those of the regions that the content lines elect. Marked articles
    are taken whole. Elsewhere the text goes from the first content line, or the heading over it, to
    the last, without the menus between: lines of links that are no content or follow each other."""
    lengths, tags = np.array([x.plain for x in lines], float), np.array([x.tags for x in lines], float)
    content = content_lines(lengths, tags, np.array([x.inside for x in lines]))
    if not lengths[content].sum():
        content = np.ones(len(lines), bool)
    regions = Regions(parents, kinds, lines, content)
    chosen, marked = regions.elected()
    inside = [i for i, x in enumerate(lines) if regions.holds(chosen[max(0, bisect_right(chosen, x.region) - 1)], x.region)]
    if not inside:
        return lines
    if marked:
        first, out = inside[0], [lines[i] for i in inside]
        return out if any(x.block == "h1" for x in out) else [*lines[_heading(lines, first) : first], *out]
    heavy = [i for i in inside if content[i]]
    first, last = _heading(lines, heavy[0]), _ending(lines, heavy[-1])
    menu = [x.linked for x in lines]
    menu = [m and (not content[i] or any(menu[max(0, i - 1) : i]) or any(menu[i + 1 : i + 2])) for i, m in enumerate(menu)]
    return [x for i, x in enumerate(lines) if first <= i <= last and not menu[i]]


def main_text(html: str | None) -> str:
    """The main text of a page: blocks joined by line feeds, white space inside a block as one
    space. Null, empty and text-free pages give an empty string; text without markup is kept."""
    page = _Lines()
    page.feed(html or "")
    page.close()
    page.flush()
    lines = unlabelled([x for x in page.lines if not x.excluded], page.labels)
    return "\n".join(x.text for x in main_lines(lines, page.parents, page.kinds)) if lines else ""


PAGES = "page_id bigint, url string, text string, n_chars bigint"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page.

    A null html counts as empty and has an empty text, null ids and urls are passed on, repeated
    rows repeat their result, other columns are ignored, an empty table gives an empty result. One
    pass without a shuffle; a page is parsed as a whole, whatever its length.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract, PAGES)
