"""Operator 3, HTML extraction by line-block distribution.

Markup is stripped so that each block of the page becomes a line. Lines that
stand in a menu, header, footer, sidebar, notice, advert, form, script, style or
comment section, told by element, role or class name, are taken out. Each line that is
left has a weight, its length; a line that is mostly links has none. Where the
page marks articles (<article>, <main>, or a class of theirs) the mark is one more
factor of the weight: a line outside of them counts an OUTSIDE-th of its length.

Over the weights, sums of sliding windows of WINDOW lines are taken. The text
surges at a line where the window sum reaches SURGE (at a marked line with any
text) and dives where the sum falls under DIVE, a single character: a window of
links alone, or on pages with marks one of short lines outside of them. The lines from each surge
to its dive are a stretch, and every stretch is kept, however small beside others.
Its ends are lines that reach the dive level alone, on pages with marks lines that
are marked or make a surge alone. A page of short lines only, without any surge,
is taken from its first line with text to its dive. Lines below the dive level inside a stretch
(menus, short notes between articles) are left out.

Null or empty html gives an empty text, as does a page of markup alone. Pages cut
off in the middle are read as far as they go; very long pages are read whole.
Repeated rows are extracted one by one, an empty table gives no rows, null ids
and urls stay null, and other columns of any name are not read. Ties do not
arise: no stretch is compared with another.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import small_batches

#: Lines in a window, the characters in it that make a surge, and those without which it dives.
WINDOW, SURGE, DIVE = 3, 60, 1
#: What divides the length of a line outside of marked articles.
OUTSIDE = 64
LINKS = 0.6  # share of a line's characters in links that makes it a menu line

_NAME = r"[a-zA-Z][^\s/>]*"
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|svg|iframe|object|canvas|math|audio|video|select|title)\b[^>]*(?<!/)>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)({_NAME})((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    rf"|<(/?)({_NAME})([^>]*)>"
    r"|<[!?/][^>]*>"
    r"|<[a-zA-Z/!?][^>]*\Z",
    re.S | re.I,
)
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("html head body article section main aside header footer nav div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption blockquote pre form fieldset legend address details summary dialog hr center hgroup".split())
_CLOSES_P = _BLOCK - {"html", "head", "body"}
_DROPPED = frozenset("head nav footer aside form button dialog menu".split())
_WORDS = (
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notice|notification|newsletter|subscri\w*|sidebar|side-?bar|menu\w*|nav|navbar|navigation|breadcrumbs?|"
    r"footer|header|masthead|comments?|commentlist|disqus|reply|replies|respond|related|recommend\w*|share|sharing|social|popup|modal|overlay|login|signup|widget|toolbar|pagination|pager|tags|skip|search"
)
_JUNK = re.compile(rf"(?:^|[\s_-])(?:{_WORDS})(?:$|[\s_-]|\d)", re.I)
#: Inside an article a name speaks of junk only where all its parts do: "share-buttons" does, "share-price" and "search" do not.
_PART = re.compile(r"[\s_-]+|(?<=\D)(?=\d)")
_WORD = re.compile(_WORDS, re.I)
_BESIDE = frozenset("block box list link links area bar button buttons wrap wrapper container section slot inner outer unit icon icons form top bottom left right inline item items search tags skip reader user post page site".split())
_OWN = re.compile(r"^(?:article|entry|post|content|story)[_-]*(?:header|title|heading|body|content|text|main)\b", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_MAIN = re.compile(r"(?:^|\s)(?:article|post|entry|story|main)[_-]?(?:body|content|text)?(?:$|\s)", re.I)


def _junk_inside(name: str) -> bool:
    parts = [p.lower() for p in _PART.split(name) if p]
    beside = [p in _BESIDE or p.isdigit() for p in parts]
    return not all(beside) and all(b or _WORD.fullmatch(p) for p, b in zip(parts, beside))


def _is_junk(name: str, attrs: str, in_article: bool) -> bool:
    if name in _DROPPED or (name == "header" and not in_article):
        return True
    if not attrs or name in ("html", "body"):
        return False
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            junk = _junk_inside if in_article else _JUNK.search
            if any(junk(c) and not _OWN.match(c) for c in value.split()):
                return True
        elif key == "role":
            if value.lower() in _ROLES:
                return True
        elif key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        elif key == "hidden" or value.lower() == "true":
            return True
    return False


def lines_of(page: str) -> list[tuple[str, int, bool, int]]:
    """(text, characters in links, junk, number of the marked article it is in or 0) of each block with text."""
    lines, text, linked = [], [], 0
    stack: list[tuple[str, bool, int, bool]] = []  # name, junk, article, link
    junk, article, link, articles = False, 0, False, 0

    def flush() -> None:
        nonlocal text, linked
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            if line:
                lines.append((line, linked, junk, article))
            text, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text.append(raw)
            if link:
                linked += len(raw)

    def close(k: int) -> None:
        nonlocal junk, article, link
        del stack[k:]
        junk, article, link = stack[-1][1:] if stack else (False, 0, False)

    at = 0
    for m in _TAG.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        attrs = m[4] or m[7] or ""
        if m[2] or m[5]:  # an end tag
            if name in _BLOCK or name == "p":
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if name not in _BLOCK and stack[k][0] in _BLOCK:
                    break  # an inline end tag does not close blocks
            continue
        if name == "br":
            add(" ")
            continue
        if name in _BLOCK:
            flush()
            if name in _CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] in _BLOCK:
                        break
            same = {"li": ("li", ("ul", "ol")), "dt": ("dt", ("dl",)), "dd": ("dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table"))}.get(name)
            if same:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in same[1]:
                        break
                    if stack[k][0] == same[0]:
                        close(k)
                        break
        if name in _VOID or attrs.endswith("/"):
            continue
        own_junk = junk or _is_junk(name, attrs, article > 0)
        own_article = article
        if not article and not own_junk and (name in ("article", "main") or (name in ("div", "section") and any(k.lower() in ("class", "id") and _MAIN.search(v.strip("\"'")) for k, v in _ATTR.findall(attrs)))):
            articles += 1
            own_article = articles
        stack.append((name, own_junk, own_article, link or name == "a"))
        junk, article, link = stack[-1][1:]
    add(page[at:])
    flush()
    return lines


def line_weights(lines: list[tuple[str, int, bool, int]]) -> tuple[list[float], list[bool]]:
    """The weight of each line (none of them junk), and whether it may begin and end a stretch."""
    marks = any(article for *_, article in lines)
    weights = []
    for text, links, _, article in lines:
        size = len(text) if article or links <= LINKS * len(text) else 0
        weights.append(size if article or not marks else size / OUTSIDE)
    return weights, [bool(article) or weight >= (SURGE if marks else DIVE) for (*_, article), weight in zip(lines, weights)]


def stretches(weights: list[float], ends: list[bool], marked: list[bool], window: int = WINDOW, surge: float = SURGE, dive: float = DIVE) -> list[tuple[int, int]]:
    """(first, after last) of the lines from each surge to its dive: all of them, between lines that may be their ends."""
    n, total = len(weights), [0.0]
    for w in weights:
        total.append(total[-1] + w)
    sums = [total[min(i + window, n)] - total[i] for i in range(n)]
    for least in (surge, dive):  # a page of short lines has no surge: then any text makes one
        found, i = [], 0
        while i < n:
            if not ends[i] or sums[i] < (dive if marked[i] else least):
                i += 1
                continue
            start = i
            while i < n and sums[i] >= dive:
                i += 1
            end = i
            while not ends[end - 1]:
                end -= 1
            found.append((start, end))
        if found:
            return found
    return []


def main_text(page: str | None, window: int = WINDOW) -> str:
    lines = [line for line in lines_of(page or "") if not line[2]]
    weights, ends = line_weights(lines)
    found = stretches(weights, ends, [bool(article) for *_, article in lines], window)
    return "\n".join(lines[k][0] for a, b in found for k in range(a, b) if weights[k] >= DIVE)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages."""
    small_batches(pages.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [main_text(h) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": found, "n_chars": [len(t) for t in found]})

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return source.mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
