"""Main text of web pages by the distribution of text over lines.

Markup is stripped so that every block of the page becomes a line, whose length is that of its text. What stands in
boilerplate elements leaves empty lines. The lengths are summed over a sliding window of lines. Where the sums surge
a text begins, where they dive to nothing it ends, and the lines between both are the main text. Tags and names of classes are
evidence: they say which lines are empty, but a name does not empty an element that holds the page's text.

Every step takes time in proportion to the page's length, whatever its markup.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# Lines in a window, empty lines that a stripped block leaves, and the window sum that counts as a surge.
WINDOW = 3
GAP = 3
SURGE = 40
# An article with so many times the text that surges outside it is taken for all of the main text.
TRUST = 2
# Without any article on the page, an element marked by its names is text all the same if it holds so many times the text beside it,
# and so many characters.
WHOLE, WHOLE_CHARS = 10, 200

# Elements of HTML by what they do to a page's text.
RAW = frozenset("script style noscript template textarea title iframe svg math canvas object select option".split())
BOILERPLATE = frozenset(
    "nav header footer aside form menu dialog button fieldset head audio video map figcaption".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words in a class, id or role that mark what surrounds an article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie "
    "cookies copyright disclaimer discussion footer form header login masthead menu menubar modal nav navbar navigation newsletter "
    "notice notices notification pager pagination popup promo promoted promotion recommended related replies reply respond rss search "
    "share sharing sidebar signup social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets "
    "contentinfo complementary alert alertdialog".split()
)
# Beginnings of class names or ids of an <article> that say it is not the page's.
NOT_MAIN = frozenset("comment comments teaser reply replies related promo advert".split())
# Marks of what may be longer than the article itself.
LONG_MARKS = frozenset(
    "comment comments commentlist discussion reply replies respond related recommended teaser promo promoted".split()
)
# Beginnings of class names that say what an element holds or lacks, not what it is.
NOT_OWN = frozenset("has with no is js without".split())
# Blocks whose lines belong together.
CONTAINERS = frozenset("article blockquote center div main section td".split())
# Elements that end an open one of their own kind.
_SAME = frozenset("li dt dd tr td th option".split())

_TAG_END = re.compile(r">|=\s*[\"']")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_NO_DISPLAY = re.compile(r"display\s*:\s*none")
_RAW_END = {x: re.compile(rf"</{x}\s*>", re.IGNORECASE) for x in RAW}
# No character has a number of so many digits.
_LONG_NUMBER = re.compile(r"&#(?:0*[1-9][0-9]{9,}|[xX]0*[1-9a-fA-F][0-9a-fA-F]{9,});?|(?<=&#)0{9,}|(?<=&#[xX])0{9,}")


def _decoded(text: str) -> str:
    if "&" not in text:
        return text
    if "&#" in text:
        text = _LONG_NUMBER.sub(lambda m: "\ufffd" if m[0][0] == "&" else "0", text)
    return html.unescape(text)


def _names(attributes: str) -> tuple[list[list[str]], bool]:
    """The parts of each class name, id and role, and whether the element is hidden."""
    names, hidden = [], False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role"):
            names += [re.split(r"[-_]+", x) for x in value.split()]
        elif key == "hidden":
            hidden |= value not in ("false", "until-found")
        elif key == "aria-hidden":
            hidden |= value == "true"
        elif key == "style":
            hidden |= bool(_NO_DISPLAY.search(value))
    return names, hidden


def tags_of(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Where the markup of a page begins and ends, the element's name (comments and declarations: none), whether it is an end tag, attributes.

    Quotes hide a `>` where they begin an attribute's value. Once a tag has no end outside of its quotes, the quotes of the rest
    of the page are not heeded. What follows an opening raw element up to its end tag is skipped. A `<` that begins no markup is text.
    """
    at, last, quotes = 0, page.rfind(">"), True
    while True:
        i = page.find("<", at)
        if i < 0 or i > last and not page.startswith("<!--", i):
            return
        if page.startswith("<!--", i):
            end = page.find("-->", i + 2)
            at = len(page) if end < 0 else end + 3
            yield i, at, "", False, ""
            continue
        if page[i + 1] in "!?":
            at = page.find(">", i) + 1
            yield i, at, "", False, ""
            continue
        ending = page[i + 1] == "/"
        name_at = i + 1 + ending
        if not (name_at < last and page[name_at].isascii() and page[name_at].isalpha()):
            at = i + 1
            continue
        end = _end_of_tag(page, name_at) if quotes else -1
        if end < 0:
            quotes, end = False, page.find(">", name_at)
        found = _NAME.match(page, name_at, end)
        name, attributes, at = found[0].lower(), page[found.end() : end], end + 1
        if name in RAW and not ending and not attributes.rstrip().endswith("/"):
            raw_end = _RAW_END[name].search(page, at)
            at = raw_end.end() if raw_end else len(page)
        yield i, at, name, ending, attributes


def _end_of_tag(page: str, at: int) -> int:
    """Where the `>` of a tag stands, -1 if there is none outside of quotes."""
    while m := _TAG_END.search(page, at):
        if m[0] == ">":
            return m.start()
        at = page.find(m[0][-1], m.end()) + 1
        if not at:
            return -1
    return -1


class _Element:
    """An element that may be boilerplate: what it stands in, whether it is for certain, and the text that it holds."""

    __slots__ = ("inside", "certain", "long", "headed", "own", "all", "named", "off")

    def __init__(self, inside: _Element | None, certain: bool, long: bool):
        self.inside, self.certain, self.long = inside, certain, long
        self.headed = self.off = False
        self.own = self.all = self.named = 0


def _judge(elements: list[_Element], articles: bool) -> None:
    """Set `off` for boilerplate; the first element is the page. Others stand after what they are in.

    An element marked by its names only, or a form, is no boilerplate if most of the text of what it stands in is in it: of articles
    `TRUST` times what stands beside the marked elements, or, on a page without articles, `WHOLE` times of any text. What is marked as
    comments or recommendations must hold the page's first heading, too.
    """
    for e in reversed(elements):
        e.all += e.own
        if e.inside and not e.certain:
            e.inside.all += e.all
            e.inside.named += e.named
    for e in elements[1:]:
        around = e.inside
        if articles:
            whole = e.named and e.named >= TRUST * around.own and 2 * e.named > around.named
        else:
            whole = e.all >= max(WHOLE_CHARS, WHOLE * around.own) and 2 * e.all > around.all
        e.off = around.off or e.certain or not whole or (e.long and not e.headed)


def lines_of(page: str) -> list[tuple[str, int, int, int]]:
    """The lines of a page without markup: text, the length of what is not a link in it, whether it is in an article, its container.

    The third is 0 outside articles, 1 in one, and 2 in one that is marked as a comment or a teaser. The last numbers the nearest
    of `CONTAINERS` around the line, 0 if there is none.

    Boilerplate elements come out as `GAP` empty lines. An element that is never closed ends with what surrounds it, and the end tag
    of an inline element closes no block, as browsers have it.
    """
    whole = _Element(None, False, False)
    elements, here = [whole], whole
    found: list[tuple[str | None, int, int, int, _Element]] = []  # a line, or None where an element ends
    words: list[str] = []
    stack: list[tuple[str, _Element | None, bool, bool]] = []  # name, the element if it may be boilerplate, beside the text, container
    places: dict[str, list[int]] = {}  # where open elements of a name are in the stack
    blocks, containers = [-1], [0]
    links = article = beside = plain = at = count = 0
    articles = headed = False

    def put(piece: str) -> None:
        nonlocal plain
        if piece and not here.certain:
            piece = _decoded(piece)
            words.append(piece)
            if not links:
                plain += len("".join(piece.split()))

    def end_line() -> None:
        nonlocal plain
        text = " ".join("".join(words).split())
        if text:
            kind = 2 if beside else int(article > 0)
            found.append((text, plain, kind, containers[-1], here))
            here.own += plain
            here.named += plain * (kind == 1)
        words.clear()
        plain = 0

    def close() -> None:
        nonlocal here, links, article, beside
        name, element, off, contains = stack.pop()
        places[name].pop()
        if name in BLOCKS:
            blocks.pop()
        if element:
            end_line()
            found.append((None, 0, 2 if beside else int(article > 0), containers[-1], element))
            here = element.inside
        if contains:
            containers.pop()
        beside -= off
        links -= name == "a"
        article -= name in ("article", "main")

    for start, end, name, ending, attributes in tags_of(page):
        put(page[at:start])
        at = end
        if not name:
            continue
        if name in BLOCKS:
            end_line()
        if ending:
            if places.get(name) and (name in BLOCKS or places[name][-1] > blocks[-1]):
                down_to = places[name][-1]
                while len(stack) > down_to:
                    close()
            continue
        if name in RAW or name in VOID:
            continue
        if stack and (stack[-1][0] == "p" and name in BLOCKS or stack[-1][0] == name and name in _SAME):
            close()
        names, hidden = _names(attributes) if attributes else ([], False)
        main = name in ("article", "main")
        marks = [x for parts in names if parts[0] not in NOT_OWN for x in parts if x in MARKS]
        element = None
        if name in BOILERPLATE or hidden or (marks and not main and name not in ("html", "body")):
            end_line()
            certain = here.certain or hidden or (name in BOILERPLATE and name != "form")
            element = here = _Element(here, certain, not LONG_MARKS.isdisjoint(marks))
            elements.append(element)
        if name == "h1" and not headed and not here.certain:
            headed, e = True, here
            while e:
                e.headed, e = True, e.inside
        off = name == "article" and any(parts[0] in NOT_MAIN for parts in names)
        contains = name in CONTAINERS
        if contains:
            count += 1
            containers.append(count)
        beside += off
        links += name == "a"
        article += main
        articles |= main and not beside and not here.certain
        places.setdefault(name, []).append(len(stack))
        if name in BLOCKS:
            blocks.append(len(stack))
        stack.append((name, element, off, contains))
    put(page[at:])
    end_line()
    while stack:
        close()

    _judge(elements, articles)
    lines: list[tuple[str, int, int, int]] = []
    for text, size, kind, container, element in found:
        if text is None:
            if element.off and not element.inside.off:
                lines += [("", 0, kind, container)] * GAP
        elif not element.off:
            lines.append((text, size, kind, container))
    return lines


def _surging(size: np.ndarray, window: int, surge: int) -> np.ndarray:
    """Which lines stand between a surge and a dive. Where no sum reaches `surge`, the largest one is a surge."""
    total = np.cumsum(np.concatenate([[0], size, np.zeros(window, np.int64)]))
    sums = total[window:] - total[:-window]  # sums[i]: lines i to i + window - 1
    alive = np.concatenate([[False], sums > 0, [False]])
    starts, ends = np.flatnonzero(alive[1:] & ~alive[:-1]), np.flatnonzero(~alive[1:] & alive[:-1])
    out = np.zeros(len(size), bool)
    surge = min(surge, int(sums.max(initial=0)))
    for i, j in zip(starts, ends):
        out[i:j] = sums[i:j].max() >= surge
    return out


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The text between surge and dive of the window sums, blocks joined by one blank.

    All of the page is searched: a run of lines between two dives counts if one of its sums reaches `surge` characters outside
    links, or is the page's largest. What text surges in goes on with it: a container (a block such as `<div>`) from its first line with text
    outside links to its last one, an article from there to its end, links included. Articles are evidence: comments and teasers
    marked as such are left out if there is other text, and if the rest of the articles hold `TRUST` times the text that surges
    outside them, or more, the main text is theirs alone. No page or no text: empty.
    """
    lines = lines_of(page)
    size, kind, container = (np.array([x[i] for x in lines], dtype=np.int64) for i in (1, 2, 3))
    if size[kind < 2].any():
        size = np.where(kind == 2, 0, size)
    else:
        kind = np.minimum(kind, 1)
    kept = _surging(size, window, surge)
    named = size[kind == 1].sum()
    if named and named >= TRUST * size[kept & (kind == 0)].sum():
        size = np.where(kind == 1, size, 0)
        kept = _surging(size, window, surge)
    kept &= size > 0
    reach: dict[int, list[int]] = {c: [] for c in set(container[kept].tolist()) - {0}}
    inside = bool((kept & (kind == 1)).any())
    begun = False
    for i in np.flatnonzero(size).tolist():
        if int(container[i]) in reach:
            reach[int(container[i])].append(i)
        kept[i] |= inside and kind[i] == 1
    for i in np.flatnonzero(kind < 2).tolist():  # a comment within an article does not end it
        ends = reach.get(int(container[i]))
        begun = bool(kind[i] == 1 and (begun or kept[i]))
        kept[i] |= begun or bool(ends and ends[0] <= i <= ends[-1])
    return " ".join(t for (t, *_), k in zip(lines, kept) if t and k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page. No shuffle; each task works page by page.

    A null html counts as empty and gives an empty text; id and address come out as they are. Repeated rows come out as often
    as they come in. Other columns are not looked at.
    """

    @F.pandas_udf("string")
    def text_of(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield batch.map(main_text)

    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_of(text_or_empty(html_col)).alias("text")
    )
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op3_html_extraction": op3_html_extraction}
ORACLE: dict[str, str] = {}
