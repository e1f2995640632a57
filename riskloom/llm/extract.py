"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element. Parts that are never article text (scripts, styles, menus, forms,
adverts, notices, reader comments and the like) leave no lines. Where a page marks its articles, all lines inside the
marks are the text. Elsewhere text lengths are summed over sliding windows of lines, and lines that are mostly link text
count as empty: where the sum leaves zero is a surge, where it falls back to zero a dive. Every stretch from a surge to
its dive with a sum of ``LEAST`` characters is text, or the longest stretch if none has so many; each line in it is kept,
however short, also those that are mostly link text.

Each page is read whole in its own row. Null or empty pages give empty text; unclosed tags end with their parent.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

WINDOW = 3
#: Characters that a window of a text stretch sums up to.
LEAST = 80
#: Elements without article text.
SKIPPED = frozenset(
    "script style noscript template svg math iframe object canvas nav menu aside form button select textarea dialog footer head title".split()
)
ARTICLE = frozenset({"article", "main"})
BLOCKS = frozenset(
    "address article aside blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Class, id and role names of parts without article text, alone or before a hyphen or underscore.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo "
    "cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice popup promo related "
    "search share sharing sidebar social sponsor sponsored subscribe widget".split()
)


def _named(attrs: list[tuple[str, str | None]]) -> bool:
    for key, value in attrs:
        if key in ("class", "id", "role") and value:
            for name in value.lower().split():
                if name in NAMES or name.replace("_", "-").split("-", 1)[0] in NAMES:
                    return True
    return False


class _Lines(HTMLParser):
    """Lines of a page as (text, characters in links, whether inside a marked article)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.skipped = self.articles = self.links = 0
        self.lines: list[tuple[str, int, bool]] = []
        self.marked = False
        self._text: list[str] = []
        self._linked = 0

    def end_line(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.lines.append((text, self._linked, self.articles > 0))
        self._text, self._linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ARTICLE and self.skipped and not any(t in ARTICLE for t, _ in self.open):
            # An article is no part of a menu or notice that was never closed.
            self.open = [(t, False) for t, _ in self.open]
            self.skipped = 0
        skip = tag in SKIPPED or (tag == "header" and not self.articles)
        skip = skip or (tag not in ARTICLE and tag not in ("html", "body") and _named(attrs))
        if not self.skipped and (tag in BLOCKS or skip):
            self.end_line()
        if tag in VOID:
            return
        self.open.append((tag, skip))
        self.skipped += skip
        if not self.skipped:
            if tag in ARTICLE:
                self.articles += 1
                self.marked = True
            self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS and not self.skipped:
            self.end_line()

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.open):
            if tag in ("br", "p") and not self.skipped:
                self.end_line()
            return
        while self.open:
            t, skip = self.open.pop()
            if not self.skipped:
                if t in BLOCKS:
                    self.end_line()
                if t in ARTICLE:
                    self.articles -= 1
                self.links -= t == "a"
            self.skipped -= skip
            if t == tag:
                break

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self._text.append(data)
            if self.links:
                self._linked += len(data.strip())


def _stretches(lengths: list[int], window: int, least: int) -> list[tuple[int, int]]:
    """First and end line of the stretches whose windows reach ``least``, or of the longest one."""
    found: list[tuple[int, int, int, int]] = []
    block, surge, end, size, most = 0, 0, 0, 0, 0
    for at, length in enumerate([*lengths, *[0] * window]):
        block += length - (lengths[at - window] if at >= window else 0)
        if length and not size:
            surge = at
        if length:
            end = at + 1
        size, most = size + length, max(most, block)
        if block == 0 and size:  # a dive
            found.append((surge, end, size, most))
            size, most = 0, 0
    reached = [(surge, end) for surge, end, _, most in found if most >= least]
    return reached or [x[:2] for x in sorted(found, key=lambda x: -x[2])[:1]]


def main_text(html: str | None, window: int = WINDOW, least: int = LEAST) -> str:
    """Text inside the marked articles, or else of all stretches between a surge and a dive."""
    page = _Lines()
    page.feed(html or "")
    page.close()
    page.end_line()
    if page.marked:
        return "\n".join(text for text, _, inside in page.lines if inside)
    lengths = [len(text) if 2 * linked <= len(text) else 0 for text, linked, _ in page.lines]
    return "\n".join(text for a, b in _stretches(lengths, window, least) for text, _, _ in page.lines[a:b])


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of each page in ``into`` (never null)."""

    @F.pandas_udf("string")
    def text_of(htmls: pd.Series) -> pd.Series:
        return htmls.map(main_text)

    return pages.withColumn(into, text_of(F.coalesce(F.col(html).cast("string"), F.lit(""))))
