"""Main text of web pages, found by text-to-tag ratios."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Elements whose text is no part of any article.
SKIPPED = frozenset("""aside button canvas datalist dialog footer form head header iframe input label map math menu nav noframes
    noscript object option script select style svg template textarea title""".split())
#: Those of them that an article or a main part ends, if the page forgot to.
WRAPPERS = frozenset(("aside", "footer", "form", "header", "menu", "nav"))
#: Parts that hold articles of their own; an article after the page's first one does not end them.
NESTING = frozenset("""comment comment-list comment-section comments comments-area comments-section disqus disqus_thread related
    related-articles related-posts replies reply respond""".split())
#: First or last pieces of a word that names readers' comments, as in "user-comments", and first pieces that tell of a state.
COMMENT_FIRST, COMMENT_LAST = frozenset(("comment", "comments")), frozenset(("comments", "replies"))
STATES = frozenset("closed disable disabled has hide is no open show toggle with without".split())
#: Whole words in class, id or role that name such a part; "has-sidebar" names none.
HINTS = NESTING | frozenset("""ad ad-container ad-slot ads advert advertisement advertising banner breadcrumb breadcrumbs consent
    cookie cookie-banner cookie-notice cookies footer header main-menu main-nav masthead menu modal nav nav-menu navbar
    navigation newsletter notice overlay page-footer pagination popup promo promotion search search-form share share-buttons
    sharing sidebar signup site-footer site-header site-nav social social-links social-share sponsor sponsored subscribe
    toolbar widget""".split())
#: Elements whose id names a part, and not a place to link to, within an article.
NAMED_BY_ID = frozenset(("div", "ol", "ul"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand within a line.
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp
    small span strike strong sub sup time tt u var wbr""".split())
#: Blocks that belong to the container around them.
WITHIN = INLINE | HEADINGS | frozenset("""address blockquote body caption colgroup dd details dl dt figcaption figure head hgroup
    hr html li ol p pre summary table tbody tfoot thead tr ul""".split())
CELLS = frozenset(("td", "th"))
MAIN = frozenset(("article", "main"))
#: Lines that the Gaussian reaches to either side, and the threshold in standard deviations of the smoothed ratios.
RADIUS, SIGMAS = 2, 0.5


def of_comments(word: str) -> bool:
    """Whether a word of class or id names readers' comments: "comments", "comment-list", "user-comments", not "has-comments"."""
    if "comment" not in word and "replies" not in word:
        return False
    pieces = re.split("[-_]+", word)
    return pieces[0] in COMMENT_FIRST or pieces[-1] in COMMENT_LAST and pieces[0] not in STATES


def hints(tag: str, attrs: list[tuple[str, str | None]], in_main: bool) -> set[str]:
    """The words of ``HINTS`` that name the element; readers' comments as "comments".

    An outermost article is named by nothing but comments.  Within an article the id of a section names comments, or else a
    place to link to.
    """
    if in_main:
        by_id = tag in NAMED_BY_ID
    else:
        by_id = tag not in HEADINGS and tag not in INLINE and tag not in ("p", "li")
    found = set()
    for key, value in attrs:
        if key not in ("class", "id", "role", "itemtype") or not value:
            continue
        if key == "itemtype":
            if value.rstrip("/").lower().endswith("schema.org/comment"):
                found.add("comments")
            continue
        for word in value.lower().split():
            if (key != "id" or by_id or tag == "section") and of_comments(word) and tag not in HEADINGS and tag not in INLINE:
                found.add("comments")
            elif (key != "id" or by_id) and word in HINTS:
                found.add(word)
    return found & COMMENTS if tag in MAIN and not in_main else found


COMMENTS = frozenset(("comments",))


#: A document type with declarations of its own, up to the bracket that ends them.
_SUBSET = re.compile(r"<!doctype[^>\[]*\[[^\]]*\]\s*>", re.IGNORECASE)


class Lines(HTMLParser):
    """Takes parser events and gathers lines: ``(text, linked characters, tags, region, inside a main part)``.

    A line ends where a block begins or ends.  A region is all lines of one container but those of containers in it;
    lists, tables and quotations are no containers.  Neither is a table cell, or a division of a container, that holds
    no block: it is a paragraph of the region around it.  The page itself is region 0, an article is one region,
    whatever it holds.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool]] = []
        # element, skipped by itself, until a main part begins, region around it if it is a container
        self.open: list[tuple[str, bool, bool, int | None]] = []
        # how many of each element are open, in all and since each open main part began; so no stray end tag looks for its start
        self.names: Counter[str] = Counter()
        self.inner: list[Counter[str]] = [Counter()]
        # places in ``open`` of skipped elements that any main part ends, and of those that the first one or a ``main`` does
        self.ending: list[int] = []
        self.named: list[int] = []
        self.seen_main = False
        self.skipping = self.in_main = self.in_link = 0
        self.parts: list[str] = []
        self.linked = self.tags = 0
        self.region = self.regions = 0
        self.without_blocks: set[int] = set()
        self.part_of: dict[int, int] = {}

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.linked, max(self.tags, 1), self.region, self.in_main > 0))
            self.linked = self.tags = 0
        self.parts.clear()

    def _reopen(self, tag: str) -> None:
        """A main part ends what the page forgot to end before it."""
        places = self.ending + (self.named if tag == "main" or not self.seen_main else [])
        for k in places:
            name, _, _, around = self.open[k]
            self._end_line()
            self.open[k] = (name, False, False, around)
            self.skipping -= 1
        self.ending.clear()
        if tag == "main" or not self.seen_main:
            self.named.clear()
        self.seen_main = self.seen_main or not self.skipping

    def _leave(self, tag: str, skipped: bool, _: bool, around: int | None) -> None:
        if around is not None:
            if self.region in self.without_blocks and (around or tag in CELLS):
                self.part_of[self.region] = around
            self.region = around
        self.skipping -= skipped
        self.in_main -= tag in MAIN
        self.in_link -= tag == "a"
        if tag in MAIN:
            self.inner.pop()
        self.names[tag] -= 1
        self.inner[-1][tag] -= 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if not self.skipping:
            self.tags += 1
        if tag in MAIN:
            self._reopen(tag)
        if tag not in INLINE and not self.skipping:
            self._end_line()
            if tag not in SKIPPED:
                self.without_blocks.discard(self.region)
        elif tag in ("br", "img", "wbr") and not self.skipping:
            self.parts.append(" " if tag == "br" else "")
        if tag in VOID:
            return
        skipped = tag in SKIPPED and not (tag == "header" and self.in_main)
        ends = skipped and tag in WRAPPERS
        if not skipped and tag not in ("html", "body"):
            named = hints(tag, attrs, self.in_main > 0)
            skipped, ends = bool(named), bool(named) and not named & NESTING and tag not in MAIN
        if skipped and not self.skipping:
            self._end_line()
        around = None
        if not skipped and not self.skipping and not self.in_main and tag not in WITHIN:
            around = self.region
            self.regions += 1
            self.region = self.regions
            if tag not in MAIN:
                self.without_blocks.add(self.region)
        self.skipping += skipped
        self.in_main += tag in MAIN
        self.in_link += tag == "a"
        if skipped and ends:
            self.ending.append(len(self.open))
        elif skipped and tag not in SKIPPED:
            self.named.append(len(self.open))
        self.open.append((tag, skipped, ends, around))
        self.names[tag] += 1
        self.inner[-1][tag] += 1
        if tag in MAIN:
            self.inner.append(Counter())

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if not self.skipping:
            self.tags += 1
            if tag not in INLINE:
                self._end_line()
        # within an article a stray end tag of an inline element ends nothing outside it
        if not (self.inner[-1] if tag in INLINE else self.names)[tag]:
            return
        while self.open:
            left = self.open.pop()
            self._leave(*left)
            if left[0] == tag:
                break
        for places in (self.ending, self.named):
            while places and places[-1] >= len(self.open):
                places.pop()

    def parse_html_declaration(self, i: int) -> int:
        """Declarations that the standard library refuses, or ends too early, are passed over."""
        raw = self.rawdata
        if raw.startswith("<![", i) and not raw.startswith("<![CDATA[", i):
            return self.parse_bogus_comment(i)
        if raw[i:i + 9].lower() == "<!doctype":
            inner = _SUBSET.match(raw, i)
            if inner:
                return inner.end()
        return super().parse_html_declaration(i)

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.parts.append(data)
            if self.in_link:
                self.linked += len(data)

    def close(self) -> None:
        super().close()
        self._end_line()
        while self.open:
            self._leave(*self.open.pop())
        self.lines = [(text, linked, tags, self.part_of.get(region, region), main)
                      for text, linked, tags, region, main in self.lines]


def tag_ratios(lines: list[tuple[str, int, int, int, bool]]) -> np.ndarray:
    """Characters outside links per tag, for every line, smoothed by a Gaussian over its neighbours in its region."""
    ratio = np.array([max(len(text) - linked, 0) / tags for text, linked, tags, _, _ in lines], dtype=float)
    region = np.array([2 * number + main for *_, number, main in lines])
    total, mass = ratio.copy(), np.ones(len(ratio))
    for reach in range(1, min(RADIUS, len(ratio) - 1) + 1):
        weight = np.exp(-2.0 * (reach / RADIUS) ** 2) * (region[reach:] == region[:-reach])
        total[reach:] += weight * ratio[:-reach]
        mass[reach:] += weight
        total[:-reach] += weight * ratio[reach:]
        mass[:-reach] += weight
    return total / mass


def main_text(html: str) -> str:
    """The lines of the regions in which a smoothed ratio reaches the threshold, joined by newlines.

    Headings and short lines belong to the region around them, whatever their own ratio.  An ``article`` or ``main``
    element is one region; if any is selected, regions outside of them are not.  Elsewhere lines between selected ones
    stay, whatever their region, and lines that are links alone count only between selected ones of their own region.
    """
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = parser.lines
    if not lines:
        return ""
    smooth = tag_ratios(lines)
    plain = [linked < len(text) or main for text, linked, _, _, main in lines]
    high = smooth >= SIGMAS * smooth.std()
    picked = [i for i in range(len(lines)) if plain[i] and high[i]]
    if any(lines[i][4] for i in picked):
        chosen = {lines[i][3] for i in picked if lines[i][4]}
        return "\n".join(text for text, _, _, region, main in lines if main and region in chosen)
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    for i in picked:
        first.setdefault(lines[i][3], i)
        last[lines[i][3]] = i
    kept = []
    for i, (text, _, _, region, main) in enumerate(lines):
        within = region in first and not main
        if (within or picked and picked[0] < i < picked[-1] and not main) if plain[i] else (within and first[region] < i < last[region]):
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """Per row ``page_id, url, text, n_chars``: the main text of ``html`` and its code points.

    Null and empty pages give an empty text, as do pages of nothing but menus and the like.  Broken markup is read as far
    as it goes: elements left open end with the one around them.  Work is per row; repeated rows get the same result, no
    rows give none, other columns are ignored.
    """
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, type=pa.string()),
                 pa.array([len(t) for t in texts], type=pa.int64())], schema.names)

    return pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html")).mapInArrow(run, schema)
