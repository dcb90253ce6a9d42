"""Main-text extraction by line-block distribution.

Markup is stripped so that every block element stands on a line of its own. Menus, forms, adverts and
other elements that are never article text leave a blank line; where an article or main element
begins or ends, a whole window of blank lines is left. The text lengths of a sliding window of lines
are then summed: where the sums surge from nothing a run of text begins, where they dive to nothing
it ends. The run with the most text is the article, with every line between its two points, however
short; other runs count as well if they hold a fair share of that. Lines that are links throughout
weigh nothing, so they neither start a run nor hold one together.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

ship(__name__)

#: Lines in a window, and the share of the longest run's text that another run must have to be kept.
WINDOW, SHARE = 3, 0.5

RAW = frozenset("script style noscript template textarea title iframe svg math object canvas select".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
DROPPED = RAW | frozenset("head nav footer aside form button dialog menu header label fieldset".split())
HOLDERS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = HEADINGS | HOLDERS | DROPPED - {"label", "button"} | frozenset(
    "address blockquote body caption center dd details div dl dt fieldset figcaption figure hgroup hr html li ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
#: Which open elements a beginning element ends, and the elements beyond which it doesn't look for them.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ()}
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar aside widget footer header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login search share sharing social comment comments disqus reply replies respond "
    "related recommended pagination pager skip copyright toolbar tags".split()
)
#: Names that even an article element of its own can have and be none.
BAD_ARTICLES = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related teaser".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
SPLIT = re.compile(r"[^a-z0-9]+")
SPACE = re.compile(r"\s+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _boilerplate(tag: str, attrs: str, in_article: bool) -> bool:
    """Whether the element is never article text, by its tag, class, id, role or style."""
    if tag in DROPPED and not (tag == "header" and in_article):  # an article's own header holds its title and standfirst
        return True
    if not attrs or not attrs.strip(" \t\r\n/") or tag in ("html", "body"):
        return False
    # parts of a compound name tell what a container is for, but not what a paragraph is
    whole = tag == "p" or tag in HEADINGS or tag == "header"
    bad = BAD_ARTICLES if tag in HOLDERS else BAD_NAMES - {"header"} if tag == "header" else BAD_NAMES
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            if any(word in bad or not whole and not bad.isdisjoint(SPLIT.split(word)) for word in value.split()):
                return True
        elif name == "role" and value in BAD_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
            return True
    return False


class Lines:
    """The page's lines while they are read: texts (blank ones are empty), and how much of each is no link."""

    def __init__(self):
        self.texts: list[str] = []
        self.plain: list[int] = []
        self.parts: list[str] = []
        self.linked = 0

    def add(self, text: str, link: bool) -> None:
        self.parts.append(text)
        if link:
            self.linked += len(SPACE.sub("", text))

    def end(self) -> None:
        raw = "".join(self.parts)
        text = SPACE.sub(" ", entities.unescape(raw)).strip()
        if text or (self.texts and self.texts[-1]):  # nested wrappers make one blank line
            self.texts.append(text)
            self.plain.append(0 if self.linked and self.linked >= len(SPACE.sub("", raw)) else len(text))
        self.parts.clear()
        self.linked = 0

    def gap(self) -> None:
        self.end()
        self.texts.extend([""] * WINDOW)
        self.plain.extend([0] * WINDOW)


def lines_of(page: str) -> Lines:
    """The page's lines. Every step takes time by what it closes, so unclosed tags cost no more than closed ones."""
    out = Lines()
    stack: list[tuple[str, bool]] = []  # block elements, links and dropped elements; whether one or an ancestor is dropped
    where: dict[str, list[int]] = {}  # places of each tag in the stack
    solid: list[int] = []  # places of the block elements that end a search for an open p

    def pop(to: int) -> bool:
        """Closes all above ``to``; whether an article or main was among them."""
        held = False
        while len(stack) > to:
            tag, dropped = stack.pop()
            where[tag].pop()
            if solid and solid[-1] == len(stack):
                solid.pop()
            held |= tag in HOLDERS and not dropped
        return held

    def last(tag: str) -> int:
        got = where.get(tag)
        return got[-1] if got else -1

    def close(to: int) -> None:
        out.end()
        if pop(to):
            out.gap()

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        dropped = bool(stack) and stack[-1][1]
        until = m.start() if m else size
        if until > at and not dropped:
            out.add(page[at:until], bool(where.get("a")))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in VOID:
            if tag == "br" and not dropped:
                out.add(" ", False)
            elif tag == "hr" and not dropped:
                out.end()
            continue
        if m[1]:  # an end tag; of inline elements only those in the stack matter
            place = last(tag)
            if tag in BLOCK and not dropped:
                out.end()
            if place >= 0:
                close(place) if tag in BLOCK else pop(place)
            continue
        if tag in BLOCK:
            if not dropped:
                out.end()
            if last("p") > (solid[-1] if solid else -1):  # a block ends an open p
                close(last("p"))
            for name in ENDS.get(tag, ()):
                if last(name) > max((last(x) for x in SCOPES[tag]), default=-1):
                    close(last(name))
        elif tag == "a" and last("a") >= 0:
            pop(last("a"))  # links don't nest
        dropped = bool(stack) and stack[-1][1]
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if m[3].rstrip().endswith("/") and tag not in BLOCK:
            continue
        bad = _boilerplate(tag, m[3], bool(where.get("article")) or bool(where.get("main")))
        if tag not in BLOCK and not bad and tag != "a":
            continue
        if tag in HOLDERS and not dropped and not bad:
            out.gap()
        if tag in BLOCK and tag != "p":
            solid.append(len(stack))
        where.setdefault(tag, []).append(len(stack))
        stack.append((tag, dropped or bad))
    out.end()
    return out


def main_text(page: str | None) -> str:
    """The article's lines, joined by newlines; empty for null, empty or text-free pages."""
    lines = lines_of(page or "")
    for weights in (lines.plain, [len(t) for t in lines.texts]):  # a page of nothing but links counts as text
        size = np.array(weights, np.int64)
        if size.any():
            break
    else:
        return ""
    n = len(size)
    sums = np.lib.stride_tricks.sliding_window_view(np.concatenate((size, np.zeros(WINDOW, np.int64))), WINDOW)[:n].sum(axis=1)
    flat = np.concatenate(([True], sums == 0, [True]))
    surge, dive = np.flatnonzero(flat[:-1] & ~flat[1:]), np.flatnonzero(~flat[:-1] & flat[1:])
    total = np.concatenate(([0], np.cumsum(size)))
    mass = total[dive] - total[surge]
    kept: list[str] = []
    for a, b in zip(surge[mass >= SHARE * mass.max()], dive[mass >= SHARE * mass.max()]):
        own = np.flatnonzero(size[a:b]) + a
        kept += [t for t in lines.texts[own[0] : own[-1] + 1] if t]
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    Null html counts as empty and gives the empty string; null urls and ids stay null; repeated
    rows are kept; other columns are not read; an empty table gives an empty result. Whole pages are
    parsed, however long, one at a time, in time in proportion to their length. Of runs of equal
    mass all are kept.
    """

    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    out = pages.select("page_id", "url", of(F.coalesce(F.col("html"), F.lit(""))).alias("text"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
