"""The main text of web pages, from the events of the standard library's streaming parser.

The page becomes lines, one for each block of text, with the number of tags in it.  The ratio of text to tags is smoothed
along the page with a Gaussian and lines above a threshold mark content.  Lines are clustered by the element that holds
them; a cluster with a marked line is a content region and is kept whole, so that short paragraphs of an article stay.
An article in the markup is a prior: where a page has one, the ratios outside of it count less.
What the markup itself names as something else (menus, notices, adverts, forms, comments) never enters a cluster,
unless the element so named holds the page's largest article or, on pages without one, most of the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by what they do to text, and words that name what is not the article.
CONTAINERS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figure figcaption footer form"
    " header html main menu nav ol section table tbody td tfoot th thead tr ul".split()
)
BLOCKS = CONTAINERS | frozenset("h1 h2 h3 h4 h5 h6 hr li option p pre summary caption legend title head".split())
SILENT = frozenset(
    "applet audio button canvas datalist dialog embed fieldset footer form frame frameset head iframe map menu meter nav"
    " noframes noscript object option optgroup output progress script select style svg template textarea title video"
    " aside".split()
)
#: Lists, tables, quotes and figures: in an article they belong to the region of the block that holds them.
PARTS = frozenset("blockquote center dd details dl figcaption figure ol table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
SELF_ENDING = frozenset("p li h1 h2 h3 h4 h5 h6 dt dd option tr td th".split())
ARTICLES = frozenset(("article", "main"))
OTHER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist"
    " consent cookie cookies disclaimer discussion disqus footer form gdpr header login masthead menu modal nav navbar"
    " navigation newsletter notice notices pager pagination popup promo promoted recommendations recommended related"
    " replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar"
    " widget widgets".split()
)
#: Words that may stand beside them in a name; any other word makes it the name of something else (has-sidebar).
PLAIN_WORDS = frozenset(
    "area bar block bottom box button buttons container footer global group icons inner item items left link links list"
    " page panel post posts primary reader readers right secondary section site slot stories thread top unit user users"
    " visitor visitors".split()
)
#: Elements among the silent that can wrap a whole page.
WRAPPERS = frozenset(("form", "fieldset"))
_NAME = re.compile(r"[a-z]+")

#: Width of the smoothing in lines, and the share of the ratios' spread that a marked line exceeds.
SIGMA, SPREAD = 1.5, 0.5
#: What a ratio outside the articles of a page counts.
OUTSIDE = 0.25


def _names_other(value: str, allowed: frozenset[str] = frozenset()) -> bool:
    """Whether one of the names in a class or id, taken whole, is that of something else than the article."""
    for name in value.split():
        words = set(_NAME.findall(name))
        if words <= OTHER_WORDS | PLAIN_WORDS and words & OTHER_WORDS - allowed:
            return True
    return False


class _Lines(HTMLParser):
    """Collects lines: (text, tags, region, in_article).

    Named elements and articles are numbered as they open and know the one around them (0 for none), so a line keeps
    only the innermost of each, however deep the markup is.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: (parts with the named element that holds them, tags, region, article).
        self.found: list[tuple[list[tuple[str, int]], int, int, int]] = []
        #: Open elements that matter: (tag, silent, article, region, named element).
        self.open: list[tuple[str, bool, int, int, int]] = []
        self.tags_open: Counter[str] = Counter()
        self.parts: list[tuple[str, int]] = []
        self.tags = 0
        self.regions = 0
        self.named_around = [0]
        self.article_around = [0]
        #: The named element that holds each article.
        self.holders = [0]

    def _now(self) -> tuple[str, bool, int, int, int]:
        return self.open[-1] if self.open else ("", False, 0, 0, 0)

    def _end_line(self) -> None:
        if self.parts:
            _, _, article, region, _ = self._now()
            self.found.append((self.parts, self.tags, region, article))
            self.tags = 0
        self.parts = []

    def _is_hidden(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in SILENT and tag not in WRAPPERS:
            return True
        for name, value in attrs:
            value = (value or "").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if name == "style" and "display:none" in value.replace(" ", ""):
                return True
        return False

    def _is_named(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        in_article = self._now()[2] > 0
        if tag in WRAPPERS or (tag == "header" and not in_article):
            return True
        for name, value in attrs:
            value = (value or "").lower()
            if name == "role" and value in OTHER_ROLES:
                return True
            if name in ("class", "id") and tag not in ("html", "body", *ARTICLES):
                if _names_other(value, frozenset(("header",)) if in_article else frozenset()):
                    return True
            elif name in ("class", "id") and tag in ARTICLES and {"comment", "teaser"} & set(value.split()):
                return True
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._end_line()
            # A block ends an open paragraph and its like.
            if tag in SELF_ENDING or tag in CONTAINERS:
                while self.open and self.open[-1][0] in SELF_ENDING and self.open[-1][0] not in CONTAINERS:
                    self.tags_open[self.open.pop()[0]] -= 1
        elif tag == "br":
            self.parts.append((" ", self._now()[4]))
        self.tags += 1
        if tag in VOID:
            return
        _, silent, article, region, named = self._now()
        hidden = silent or self._is_hidden(tag, attrs)
        is_named = not hidden and self._is_named(tag, attrs)
        if is_named:
            self.named_around.append(named)
            named = len(self.named_around) - 1
        if hidden or named or tag in CONTAINERS:
            if tag in CONTAINERS and not (article and tag in PARTS):
                self.regions += 1
                region = self.regions
            if tag in ARTICLES and not hidden and not is_named:
                self.article_around.append(article)
                self.holders.append(named)
                article = len(self.holders) - 1
            self.open.append((tag, hidden, article, region, named))
            self.tags_open[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1
        if not self.tags_open[tag]:
            return
        for place in range(len(self.open) - 1, -1, -1):
            if self.open[place][0] == tag:
                self.tags_open.subtract(x[0] for x in self.open[place:])
                del self.open[place:]
                break
            # Only an element's own end closes what it hides; a stray end inside an article doesn't close the article.
            if tag not in CONTAINERS and self.open[place][0] in CONTAINERS:
                break

    def handle_data(self, data: str) -> None:
        _, silent, _, _, named = self._now()
        if not silent:
            self.parts.append((data, named))

    def _kept(self) -> list[bool]:
        """For each named element, whether its text counts: with what holds it, it holds the largest article, or on a
        page without one most of the text."""
        sizes, articles = [0] * len(self.named_around), [0] * len(self.holders)
        total = 0
        for parts, _, _, article in self.found:
            for text, named in parts:
                size = len("".join(text.split()))
                total += size
                sizes[named] += size
                # What has a name of its own inside an article is not counted for it.
                if article and named == self.holders[article]:
                    articles[article] += size
        for article in range(len(articles) - 1, 0, -1):
            around = self.article_around[article]
            if around and self.holders[around] == self.holders[article]:
                articles[around] += articles[article]
        kept = [False] * len(sizes)
        if any(articles):
            named = self.holders[max(range(1, len(articles)), key=lambda article: (articles[article], -article))]
            while named:
                kept[named] = True
                named = self.named_around[named]
        else:
            for named in range(len(sizes) - 1, 0, -1):
                kept[named] = 2 * sizes[named] > total
                sizes[self.named_around[named]] += sizes[named]
        kept[0] = True
        for named in range(1, len(kept)):
            kept[named] = kept[named] and kept[self.named_around[named]]
        return kept

    def finish(self) -> list[tuple[str, int, int, bool]]:
        self.close()
        self._end_line()
        kept = self._kept()
        lines, carried = [], 0
        for parts, tags, region, article in self.found:
            text = " ".join("".join(data for data, named in parts if kept[named]).split())
            carried += tags
            if text:
                lines.append((text, carried, region, article > 0))
                carried = 0
        return lines


def marked(ratios: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Lines whose smoothed ratio of text to tags, times their prior, is above the threshold."""
    reach = int(np.ceil(3 * SIGMA))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    smooth = np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weight
    return smooth * prior >= SPREAD * (ratios * prior).std()


def main_text(html: str) -> str:
    parser = _Lines()
    parser.feed(html)
    lines = parser.finish()
    if not lines:
        return ""
    ratios = np.array([len(text) / max(1, tags) for text, tags, _, _ in lines])
    inside = np.array([line[3] for line in lines])
    prior = np.where(inside | ~inside.any(), 1.0, OUTSIDE)
    regions = {line[2] for line, good in zip(lines, marked(ratios, prior), strict=True) if good}
    return "\n".join(text for text, _, region, _ in lines if region in regions)


def extract_pages(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (its code points) in place of the html.

    Null and empty html give an empty text.  Null and repeated ids pass through, and so do other columns; columns named
    text or n_chars are replaced.
    """
    carried = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]
    rows = pages.select(*carried, F.coalesce(F.col(html_column), F.lit("")).alias("__html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html) for html in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*carried, "text", "n_chars"])

    schema = pages.select(*carried).schema.add("text", "string").add("n_chars", "long")
    return rows.mapInArrow(work, schema)
