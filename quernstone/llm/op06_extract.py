"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one for each block element, whose weight is the number of their characters outside of links. Lines
within elements that are named or marked as a menu, header, footer, sidebar, notice, advert, form or comments, and lines that are
mostly links, weigh nothing. The weights are summed over sliding windows of WINDOW lines. Where a sum is nothing the text has ended
(a dive); what lies between two dives is a stretch, and text from the first to the last stretch in which a window surges to SURGE is
kept, less the marked lines in it. A short line is a line like others: none goes for its length.

Tags are weights: an article's lines weigh something even if they are links, and make its stretch surge, as main does; outside of these,
on a page that has them, a stretch is kept only if it surges by its own text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Lines of a window, and characters in a window from which text begins (or the most of the page, if that is less).
WINDOW, SURGE = 4, 120
#: Share of a line's characters in links, and number of links in one line, from which it is a menu.
LINKS, MENU_LINKS = 0.6, 3

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|svg|math|iframe|object|textarea|title)\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[a-zA-Z/!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUT = frozenset("nav footer aside form button select head dialog menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog form menu menubar toolbar".split())
#: Class names and ids, whole, of the parts that aren't the article; and of those that aren't even within an article or main element.
_PARTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar side-bar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments comment-list commentlist disqus disqus_thread replies respond cookie cookies cookie-consent consent notice gdpr popup modal overlay newsletter subscribe signup share sharing social social-share related related-posts related-articles recommended widget toolbar pagination pager login".split()
)
_PARTS_INSIDE = frozenset("ad ads advert adverts advertisement advertisements adsense sidebar side-bar nav navbar navigation menu footer comment comments comment-list commentlist disqus_thread cookie-consent cookie-notice notice".split())
#: Longer names of the same parts, whole as well: a part and what such parts are built of.
_ADDED = re.compile(
    r"(?:ad|ads|advert|advertisement)[-_](?:slot|box|container|banner|unit|wrapper|block|space|label)|(?:cookie|cookies|consent|gdpr)[-_](?:banner|notice|bar|consent|popup)|comments?[-_](?:list|section|form|area|thread|wrapper)"
)
#: Outside of articles also with any addition before or after, as in "cookie_bar" or "main-nav".
_ADDED_OUTSIDE = re.compile(
    r"(?:ad|ads|advert|advertisement|cookie|cookies|gdpr|newsletter|sidebar|breadcrumbs?|comments?|nav|menu|navbar|promo|sponsored|share|social|popup|modal)[-_][\w-]+"
    r"|[\w-]+[-_](?:ad|ads|advert|advertisement|sidebar|nav|navbar|menu|navigation|breadcrumbs?|comments)|(?:site|page|main|global|top)[-_]?(?:header|footer)|(?:cookie|consent|promo|ad|top)[-_]?(?:banner|notice|bar)"
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def boilerplate(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is one of the parts that aren't the article, by its name or what its attributes say."""
    if name in _OUT or name == "header" and not in_article:
        return True
    if not attributes.strip() or name in ("html", "body", "article", "main") and "comment" not in attributes:
        return False
    for attribute, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        match attribute.lower():
            case "hidden":
                return True
            case "aria-hidden" if value == "true":
                return True
            case "style" if _HIDDEN.search(value):
                return True
            case "role" if value in _ROLES:
                return True
            case "class" | "id" if any(x in _PARTS_INSIDE or _ADDED.fullmatch(x) or not in_article and (x in _PARTS or _ADDED_OUTSIDE.fullmatch(x)) for x in value.split()):
                return name not in ("html", "body", "main")
    return False


@dataclass
class Line:
    text: str
    weight: int  # characters outside of links; 0 in marked parts and lines that are mostly links, but 1 at least in headings and articles
    inside: bool  # of an article or main element
    marked: bool  # as no part of the article


def lines_of(html: str) -> list[Line]:
    """The lines of a page in order. A marked part that is never closed ends with the element it is in, or where an article or main element begins."""
    lines: list[Line] = []
    parts: list[str] = []
    linked = at = articles = mains = links = 0
    skip, in_link, heading = "", False, False
    opened: Counter = Counter()  # elements that are open outside of the marked part, and within it
    within: Counter = Counter()

    def end_line() -> None:
        nonlocal linked, links
        text = " ".join((unescape(raw) if "&" in raw else raw).split()) if (raw := "".join(parts)) else ""
        if text:
            marked = bool(skip) or linked > LINKS * len(text) and links >= MENU_LINKS and not articles
            weight = 0 if marked or linked > LINKS * len(text) else max(1, len(text) - linked)
            lines.append(Line(text, max(weight, int((heading or articles > 0) and not marked)), articles + mains > 0, marked))
        parts.clear()
        linked = links = 0

    def text(piece: str) -> None:
        nonlocal linked
        parts.append(piece)
        linked += len(piece) if in_link else 0

    for tag in _TAG.finditer(html):
        if tag.start() > at:
            text(html[at : tag.start()])
        at = tag.end()
        name = (tag[3] or "").lower()
        if not name:
            continue  # a comment, an element without text, or a broken tag
        closing = bool(tag[2])
        lasting = name not in _VOID and not tag[4].endswith("/")
        if skip:
            begins = name in ("article", "main") and not closing and skip not in ("article", "main", "section", "div")
            ends = closing and (name in ("body", "html") or not within[name] and opened[name] > 0)
            if begins or ends:
                end_line()
                skip = ""
            else:
                if closing and name == skip and within[name] == 1:
                    end_line()
                    skip = ""
                elif lasting:
                    within[name] = max(0, within[name] + (-1 if closing else 1))
                if name == "a":
                    in_link = not closing
                    links += in_link
                elif name in _BLOCKS:
                    end_line()
                continue
        if not closing and lasting and boilerplate(name, tag[4], articles + mains > 0):
            end_line()
            skip, heading = name, False
            within = Counter({name: 1})
            continue
        if lasting:
            opened[name] = max(0, opened[name] + (-1 if closing else 1))
        if name == "a":
            in_link = not closing
            links += in_link
        elif name in _BLOCKS:
            end_line()
            heading = name in _HEADINGS and not closing
            articles = opened["article"]
            mains = opened["main"]
    if at < len(html):
        text(html[at:])
    end_line()
    return lines


def text_stretches(weights: list[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(from, to, most): the lines between the dives of the curve of window sums, and the largest sum of a window there.

    All lines of a window that sums to nothing are a dive. Stretches begin and end with a line that weighs something; of fewer lines than a window they may be the
    whole page.
    """
    n = len(weights)
    sums = [sum(weights[i : i + window]) for i in range(max(1, n - window + 1))]
    low = [False] * n
    for i, s in enumerate(sums):
        if not s:
            low[i : i + window] = [True] * len(low[i : i + window])
    found, start = [], None
    for i in range(n + 1):
        if i < n and not low[i]:
            start = i if start is None else start
        elif start is not None:
            a, b = start, i
            while a < b and not weights[a]:
                a += 1
            while a < b and not weights[b - 1]:
                b -= 1
            if a < b:
                found.append((a, b, max(sums[max(0, start - window + 1) : b])))
            start = None
    return found


def kept(lines: list[Line], surge: int = SURGE) -> list[Line]:
    """The lines that text_stretches and their surges keep."""
    runs: list[tuple[int, int, int, bool]] = []
    at = 0
    for inside, group in groupby(lines, key=lambda x: x.inside):
        own = list(group)
        runs += [(at + a, at + b, most, inside) for a, b, most in text_stretches([x.weight for x in own])]
        at += len(own)
    if not runs:
        return []
    least = min(surge, max(most for _, _, most, _ in runs))
    surging = [r for r in runs if r[3] or r[2] >= least]
    if not any(r[3] for r in runs):  # no article says what else belongs to it
        surging = [r for r in runs if surging[0][0] <= r[0] <= surging[-1][0]]
    return [x for a, b, _, _ in surging for x in lines[a:b] if not x.marked]


def main_text(html: str) -> str:
    """The article of a page, blocks joined by a space; empty if there is none."""
    return " ".join(x.text for x in kept(lines_of(html)))


def extract_main(pages: DataFrame, key: str = "page_id", html: str = "html", also: tuple[str, ...] = ("url",)) -> DataFrame:
    """key, the columns of `also`, text and n_chars (its code points) for each row of pages.

    Null html counts as empty and gives an empty text, as does a page without a stretch of text. Broken and cut-off markup is
    read as far as it goes. Repeated rows give the same text; no rows give no rows. Columns of `also` named text
    or n_chars are replaced.
    """
    columns = [key, *(c for c in also if c not in ("text", "n_chars"))]
    prepared = pages.select(*columns, text_of(html).alias("whole html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*columns, "text", "n_chars"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*columns).schema)
    return prepared.mapInArrow(extract, f"{fields}, text string, n_chars long")
