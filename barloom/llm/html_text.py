"""Main-text extraction from HTML: parser events, text-to-tag ratios, smoothing, clustering.

The standard library's parser streams events; block elements end a line, so a
line is what a reader sees as one block.  Every line has its text, the number of
tags met in it and the number of characters inside links.  Lines inside elements
that never hold an article (menus, headers, footers, sidebars, forms, scripts,
and elements whose class, id or role says advert, notice, comments and the like)
are set aside first.  Inside an article a class or id does so only if it speaks of adverts or all its words
name such a section or plain structure (``share-buttons``, ``related-posts``), and not on a heading or paragraph.  Where it
also names something else (``share-price``, ``promo-week``) it leaves the matter open, and the clusters
decide: of such a section the lines stay that are content.

The text-to-tag ratios of the remaining lines are smoothed with a Gaussian kernel
and split by a threshold into content and other lines.  Where a page marks
articles (or, failing that, a main part), only lines inside them compete, and a
marked element with content lines is a content region, kept whole.  Elsewhere the
region is the smallest container that holds all content lines; of it stays what lies
from the first to the last of them or beside one in the same container, with its
headings and the page's h1.  There, runs of lines that are mostly links are left out,
but not a single such line between content lines.

Work and memory are linear in the page, however deep its elements nest: a line knows its
innermost element, container and marked element, and sums go from children to parents once.
An inline element that is left open ends with its block, and its end tag closes no block.

Malformed declarations (``<![foo``, ``<!x``) are bogus comments that end at the next
``>`` or with the page; nothing that a page holds stops a task.

Edge cases: null and empty html give an empty text; a page without content lines
gives an empty text; unclosed elements end with their container; repeated rows
are extracted once each; null ids and urls are kept; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import small_batches

SIGMA, RADIUS = 1.0, 3
THRESHOLD = 0.5
LINKS = 0.5

# Element names by what they do to a line.
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("script style noscript template head title nav header footer aside form button select option textarea iframe object svg canvas menu dialog audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion disclaimer "
    "disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion "
    "related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription tags toc toolbar topbar widget".split()
)
PLAIN = frozenset(
    "area article bar block body bottom box button buttons card class cell col column container content count entry expand fixed form group head heading holder icon icons inner item "
    "items label left line link links list main media message middle mobile module outer page panel popular post posts reader readers right row section single site slot small sticky "
    "story text title top unit user view wrap wrapper zone action actions call cta inline latest more out recent stories thread".split()
)
ADVERTS = frozenset("ad ads adslot advert adverts advertisement advertising sponsor sponsored disqus".split())
CONTAINERS = frozenset("html body div section center table tbody tr td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _never(tag: str, named: dict[str, str | None]) -> bool:
    """Elements that hold no article text by their name or because they are not shown."""
    style = (named.get("style") or "").replace(" ", "").lower()
    return tag in ASIDE or "hidden" in named or "display:none" in style or named.get("aria-hidden") == "true"


ASIDE_NAME, OPEN_NAME = 1, 2


def _name_says(tag: str, named: dict[str, str | None], inside: bool) -> int:
    """Whether role, class or id speak of something beside the article; inside one, ``OPEN_NAME`` where they also name something else."""
    if tag in ("html", "body", "main") or not named or (inside and (tag in HEADINGS or tag == "p")):
        return 0
    if tag != "article" and (named.get("role") or "").lower() in ROLES:
        return ASIDE_NAME
    said = 0
    for name in f"{named.get('class') or ''} {named.get('id') or ''}".split():
        words = set(_SPLIT.split(_CAMEL.sub("-", name).lower())) - ({"header"} if inside else set())
        if WORDS.isdisjoint(words):
            continue
        if not inside or not ADVERTS.isdisjoint(words) or all(len(w) < 3 or w in WORDS or w in PLAIN or w == "header" for w in words):
            return ASIDE_NAME
        said = OPEN_NAME
    return said


class _Line(NamedTuple):
    text: str
    tags: int
    linked: int
    element: int  # innermost open element
    heading: str  # outermost open heading
    box: int  # innermost container
    article: int  # outermost marked elements
    main: int
    asked: bool  # in a section whose name leaves open what it is


class _Lines(HTMLParser):
    """Collects lines with their places among the open elements; elements are numbered as they open, so parents come before children."""

    def __init__(self, by_name: bool = True):
        super().__init__(convert_charrefs=True)
        self.by_name = by_name
        self.open: list[tuple[str, int, int, int, bool]] = []  # tag, number, what it adds to ``aside`` and ``never``, name left open
        self.parent = [0]
        self.depths: dict[str, list[int]] = {}  # where elements of a tag are open
        self.blocks: list[int] = []
        self.boxes, self.articles, self.mains, self.headings = [0], [], [], []
        self.lines: list[_Line] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.links = self.aside = self.never = self.inside = self.asked = 0
        self.semantic: dict[int, str] = {}
        self.containers: set[int] = set()

    def parse_html_declaration(self, i):
        """A declaration ends at the next ``>``; ``<![CDATA[`` and the like at their own mark if it is there."""
        raw = self.rawdata
        if raw.startswith("<!--", i):
            return self.parse_comment(i)
        end = raw.find("]]>", i) if raw[i : i + 9].upper() == "<![CDATA[" else -1
        if end >= 0:
            return end + 3
        if raw[i : i + 9].lower() == "<!doctype" and (subset := re.compile(r"[^>\[]*\[[^\]]*\]\s*>").match(raw, i)):
            return subset.end()  # a document type with its internal subset
        end = raw.find(">", i)
        return end + 1 if end >= 0 else -1

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text and not self.aside:
            first = lambda numbers: numbers[0] if numbers else 0
            element = self.open[-1][1] if self.open else 0
            heading = self.headings[0] if self.headings else ""
            self.lines.append(_Line(text, max(1, self.tags), self.linked, element, heading, self.boxes[-1], first(self.articles), first(self.mains), self.asked > 0))
        self.parts, self.tags, self.linked = [], 0, 0

    def drop_to(self, depth: int) -> None:
        while len(self.open) > depth:
            tag, number, aside, never, asked = self.open.pop()
            self.depths[tag].pop()
            self.aside -= aside
            self.never -= never
            self.asked -= asked
            self.links -= tag == "a"
            self.inside -= tag == "article"
            if tag in BLOCKS:
                self.blocks.pop()
            if tag in HEADINGS:
                self.headings.pop()
            for kept in (self.boxes, self.articles, self.mains):
                if kept and kept[-1] == number:
                    kept.pop()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.end_line()
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        ends = CLOSED_BY.get(tag)
        if ends and self.blocks and self.open[self.blocks[-1]][0] in ends:
            self.drop_to(self.blocks[-1])
        named, main = dict(attrs), tag in ("article", "main")
        never = int(_never(tag, named) and not (tag == "header" and self.inside))
        says = _name_says(tag, named, self.inside > 0) if self.by_name else 0
        aside = int(never or says == ASIDE_NAME)
        number = len(self.parent)
        self.parent.append(self.open[-1][1] if self.open else 0)
        if main and not aside and self.aside and not self.never and not self.semantic:
            aside = -self.aside  # the page's main part, inside a wrapper whose name misleads
        if main and self.aside + aside == 0:
            self.semantic[number] = tag
            (self.articles if tag == "article" else self.mains).append(number)
        if tag in CONTAINERS:
            self.containers.add(number)
            self.boxes.append(number)
        self.depths.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        if tag in HEADINGS:
            self.headings.append(tag)
        self.open.append((tag, number, aside, never, says == OPEN_NAME))
        self.aside += aside
        self.never += never
        self.asked += says == OPEN_NAME
        self.links += tag == "a"
        self.inside += tag == "article"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        at = self.depths.get(tag)
        if at and (tag in BLOCKS or not self.blocks or at[-1] > self.blocks[-1]):
            self.drop_to(at[-1])

    def handle_data(self, data):
        if not self.aside:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian smoothing; the kernel is renormalised at the ends."""
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    full = slice(RADIUS, RADIUS + len(ratios))
    return np.convolve(ratios, kernel)[full] / np.convolve(np.ones_like(ratios), kernel)[full]


def main_text(html: str | None) -> str:
    """The article's blocks in page order, joined by one space."""
    if not html:
        return ""
    for by_name in (True, False):  # names are ignored where they would leave nothing
        parser = _Lines(by_name)
        parser.feed(html)
        if parser.rawdata.startswith("<!"):  # a comment or declaration that never ends
            parser.rawdata = ""
        parser.close()
        parser.end_line()
        lines = parser.lines
        if lines or parser.semantic:
            break
    marked = False
    for kind in ("article", "main"):
        if within := [x for x in lines if getattr(x, kind)]:
            lines, marked = within, True
            break
    else:
        lines = [] if parser.semantic else lines  # what a page marks is empty: so is its article
    if not lines:
        return ""
    level = smoothed(np.array([len(x.text) / x.tags for x in lines], float))
    plain = np.array([x.linked <= LINKS * len(x.text) for x in lines])
    dense = level >= THRESHOLD * level.std()
    content = dense & plain
    if marked and not content.any():
        content = dense  # an article of links
    if not content.any():
        return ""
    size = np.array([len(x.text) for x in lines]) * content
    if marked:
        held: dict[int, int] = {}
        for n, x in zip(size, lines, strict=True):
            held[getattr(x, kind)] = held.get(getattr(x, kind), 0) + int(n)
        kept = [held[getattr(x, kind)] > 0 and (c or not x.asked) for x, c in zip(lines, content, strict=True)]
    else:
        kept = _unmarked(parser, lines, plain, content, size)
    return " ".join(x.text for k, x in zip(kept, lines, strict=True) if k)


def _unmarked(parser: _Lines, lines: list[_Line], plain: np.ndarray, content: np.ndarray, size: np.ndarray) -> list[bool]:
    """Which lines of a page without marked elements are its article."""
    held = [0] * len(parser.parent)
    for n, x in zip(size, lines, strict=True):
        held[x.element] += int(n)
    for number in range(len(held) - 1, 0, -1):  # children before parents
        held[parser.parent[number]] += held[number]
    region = max((n for n in parser.containers if held[n] == size.sum()), default=0)  # numbered as they open: the last is the deepest
    within = [not region] * len(held)
    for number in range(1, len(held)):
        within[number] = not region or number == region or within[parser.parent[number]]
    first, last = np.flatnonzero(content)[[0, -1]]
    beside = {x.box for x, c in zip(lines, content, strict=True) if c}
    framed = np.concatenate([[True], plain, [True]])
    text = plain | (framed[:-2] & framed[2:] & (np.arange(len(lines)) > first) & (np.arange(len(lines)) < last))
    kept = [bool(t) and bool(x.heading or first <= k <= last or x.box in beside) and within[x.element] for k, (t, x) in enumerate(zip(text, lines, strict=True))]
    if not any(k and x.heading == "h1" for k, x in zip(kept, lines, strict=True)):
        kept = [k or x.heading == "h1" for k, x in zip(kept, lines, strict=True)]
    return kept


EXTRACTED = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, EXTRACTED)
