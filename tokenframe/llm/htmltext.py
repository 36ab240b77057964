"""Main text of web pages by the distribution of text over lines.

Markup is stripped to lines, one for each block element; blocks that the markup itself names as page
furniture (navigation, footers, forms, asides, adverts, comments ...) are stripped with it, and so is
what stands outside an article element where the page has one. A line's length is its text's, or 0
if most of it is links. Lengths are summed over a sliding window of lines: a region begins where the
sum surges over a threshold and dives where a window of lines is empty. What lies between is the
text. So lists of links go, wherever they stand, and with them the headings that lead into them and
the labels between them.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = frozenset("script style noscript template textarea title iframe svg object select noembed xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var".split())
FURNITURE = frozenset("nav footer aside form button dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
HINTS = frozenset(
    "nav navbar navigation menu footer sidebar ad ads advert advertisement adsense sponsor sponsored promo banner cookie cookies consent notice popup modal "
    "newsletter subscribe login share social comment comments replies disqus related breadcrumb breadcrumbs pagination widget".split()
)
HEADS = frozenset(["header", "masthead", "topbar"])
ARTICLE = frozenset(["article", "main"])
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
REPEATED = frozenset("li dt dd tr td th option".split())  # one ends where the next begins
SENTENCE = re.compile("[.!?\u2026\u3002][\\])\"'\u201d\u2019\u00bb]*$")
SPACES = re.compile(r"\s+")


@dataclass
class Line:
    text: str
    links: int  # characters inside anchors
    inside: bool  # of an article or main element
    heading: int  # its level, 0 for other lines


def _attributes(source: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(source)} if source.strip(" /\t\n\r") else {}


def _is_furniture(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    if tag in FURNITURE or (tag == "header" and not inside) or "hidden" in attrs or attrs.get("role", "").lower() in ROLES:
        return True
    if tag in ARTICLE or tag in ("html", "body"):
        return False
    named = set(re.split(r"[^a-z0-9]+", f"{attrs.get('class', '')} {attrs.get('id', '')}".lower())) if attrs else set()
    return not HINTS.isdisjoint(named) or (not inside and not HEADS.isdisjoint(named))


class _Open:
    """The open elements; each step costs the elements that it opens or closes."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool]] = []  # tag, furniture, inside an article
        self.blocks: list[int] = []  # places of block elements in the stack
        self.count: Counter = Counter()

    def push(self, tag: str, furniture: bool, inside: bool) -> None:
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, furniture, inside))
        self.count[tag] += 1

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            self.count[self.stack.pop()[0]] -= 1
        while self.blocks and self.blocks[-1] >= size:
            self.blocks.pop()

    def close(self, tag: str) -> None:
        n = len(self.stack) - 1
        while self.stack[n][0] != tag:
            n -= 1
        self.cut(n)

    def close_implied(self, tag: str) -> None:
        """A block ends an open paragraph, an item the item before it."""
        if self.blocks:
            last = self.stack[self.blocks[-1]][0]
            if last == "p" or (last == tag and tag in REPEATED):
                self.cut(self.blocks[-1])

    def top(self) -> tuple[str, bool, bool]:
        return self.stack[-1] if self.stack else ("", False, False)


def lines_of(page: str) -> list[Line]:
    """The page's blocks in order, furniture left out, with character references decoded and white
    space collapsed."""
    out: list[Line] = []
    parts: list[str] = []
    links = 0
    open_ = _Open()

    def close() -> None:
        nonlocal links
        if parts:
            said = SPACES.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if said:
                out.append(Line(said, links, open_.top()[2], next((i for i, h in enumerate(HEADINGS, 1) if open_.count[h]), 0)))
        links = 0

    def add(piece: str) -> None:
        nonlocal links
        if open_.top()[1]:
            return
        parts.append(piece)
        if open_.count["a"]:
            links += len(piece)

    at, last = 0, page.rfind(">")
    while at <= last and (m := TOKEN.search(page, at)):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        ends, source = bool(m["end"] or m["end2"]), m["attrs"] or m["attrs2"] or ""
        if not ends and tag in RAW:
            if not (tag == "svg" and source.rstrip().endswith("/")):
                done = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = done.end() if done else len(page)
            continue
        block = tag not in INLINE
        if tag in VOID:
            if tag == "hr":
                close()
            elif tag == "br":
                parts.append("\n")
        elif ends:
            if open_.count[tag]:
                if block:
                    close()
                open_.close(tag)
        else:
            if block:
                close()
                open_.close_implied(tag)
            _, furniture, inside = open_.top()
            attrs = _attributes(source)
            now = furniture or _is_furniture(tag, attrs, inside)
            if block or not source.rstrip().endswith("/"):
                open_.push(tag, now, inside or tag in ARTICLE or attrs.get("itemprop") == "articleBody" or attrs.get("role") == "main")
    if at < len(page):
        add(page[at:].split("<")[0] if re.match(r"[^<]*<[a-zA-Z/!]", page[at:]) else page[at:])
    close()
    return out


def main_lines(lines: list[Line], window: int = 3, surge: int = 80) -> list[int]:
    """Which of the lines are the main text.

    Lines fall into runs, which end where the sum dives: `window` lines in a row are empty. A run's
    region goes from its first surge, or a heading right before it, to the run's end, less the
    headings that lead into the links there; a title (h1) is kept across links too. On pages
    without an article a run that never surges has no region, and mostly linked lines stay out.
    In an article all of a run is its region if it surges or has a line that ends as a sentence,
    and linked lines inside a run stay. Where no sum reaches the threshold, the greatest
    is the threshold.
    """
    marked = any(x.inside for x in lines)
    own = [i for i, x in enumerate(lines) if x.inside or not marked]
    size = [0 if 2 * lines[i].links > len(lines[i].text) else len(lines[i].text) for i in own]
    level = [lines[i].heading for i in own]
    n = len(own)
    sums = [sum(size[i : i + window]) for i in range(n)]
    least = max(min(surge, max(sums, default=0)), 1)
    kept: list[int] = []
    i = done = 0
    while i < n:
        if not size[i]:
            i += 1
            continue
        j = i
        while j < n and sums[j]:
            j += 1
        start = next((k for k in range(i, j) if sums[k] >= least), None)
        if marked and (start is not None or any(size[k] and SENTENCE.search(lines[own[k]].text) for k in range(i, j))):
            start = i
        if start is not None:
            end = j
            while j < n and end > start and (level[end - 1] or not size[end - 1]):
                end -= 1
            k, before = start - 1, []
            while k >= done and (not size[k] or level[k] == 1 or (level[k] and k >= i)):
                before += [k] if size[k] else []
                k -= 1
            kept += [*reversed(before), *(k for k in range(start, end) if size[k] or marked)]
            done = j
        i = j
    return [own[k] for k in kept]


def main_text(page: str, window: int = 3, surge: int = 80) -> str:
    """The main text of a page, its blocks joined by line breaks; "" where there is none."""
    lines = lines_of(page)
    return "\n".join(lines[i].text for i in main_lines(lines, window, surge))


def extract(page: Column) -> Column:
    """String column of main texts; null and empty pages give the empty text."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x) if x else "" for x in column.to_pylist()], pa.string())

    return run(page)


def texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text, n_chars, one row for each row of pages."""
    got = pages.select(F.col(id_col), F.col(url_col), extract(F.col(html_col)).alias("text"))
    return got.withColumn("n_chars", F.length("text").cast("long"))
