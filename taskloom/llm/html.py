"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Blocks in menus, page headers, footers, sidebars, notices, adverts,
forms and comments are bad by their place and decide nothing about others. The first pass gives each other block a
class by its length, its share of stop words and the share of its characters in links: good, bad or undecided. The
second pass gives an undecided block the class of the nearest decided block (the better one at equal distance).

In an article or main element the page itself says what its text is: there only the entries of lists of links are bad,
and they decide nothing either, so all else of it is good. Outside of it, blocks with no decided one on the page are
bad.

Stop words know four languages only. So blocks in another script are judged by length and links alone, and so are all
blocks where a page has no article and no good block. If none of those is long either, short ones of few links that end
as a sentence does are good.

A class or id marks a place by whole words of its names (``cookie-notice``), but not where the name says that something
has or hasn't it (``has-sidebar``, ``no-ads``). If all articles of a page are in places that are bad by their names,
these names are layout and don't count for what holds an article, except those of comments.

A self-closing svg is empty, and custom elements such as svg-icon are elements like any others.
Null html is an empty page. Unclosed and cut-off markup is read as far as it goes. Pages are read whole, very long
and deep ones in time linear in their length. Repeated rows have a row each. Extra columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.llm.common import prepare

# Frequent words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """the of and to in is it that for on with as was are be this by at from or an not have has they which one you had but
    de la le et les des en un une du que qui dans pour est sur au avec ne se pas par plus ce il elle sont
    der die und den von zu das mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach
    el los las y por con para su al lo como más o pero sus le ya este sí porque esta entre cuando muy sin sobre
    """.split()  # noqa: SIM905
)
#: Elements whose text is never part of the page's text.
_SILENT = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "head", "title", "select", "textarea", "button", "option"}
#: Elements that are bad by their place.
_ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog"}
_ARTICLE = {"article", "main"}
_LISTS = {"ul", "ol", "menu", "dl"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"}
_NESTING = {"article", "aside", "blockquote", "body", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "header", "main", "menu", "nav", "ol", "section", "table", "ul", "span"} | _SILENT
#: Words of class and id that mark menus, notices, adverts, sidebars and comments.
_MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "cookie", "cookies", "consent", "notice", "notices", "gdpr", "popup", "modal", "newsletter", "subscribe", "signup", "share", "sharing", "social", "related", "recommended", "comment", "comments", "disqus", "replies", "widget", "pagination", "pager"}
#: Of those, the ones of readers' comments; and words that say that a page has such a part or hasn't.
_REPLIES = {"comment", "comments", "disqus", "replies"}
_HAVING = {"has", "have", "no", "not", "with", "without", "hide", "hides", "is"}
#: Attributes of a tag; longer ones than these bounds make a tag without attributes, so that no tag is searched to the page's end.
_ATTRIBUTES = r"(?:[^\"'>]+|\"[^\"]{0,65536}\"|'[^']{0,65536}'){0,1024}+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<svg(?=[\s/>]){_ATTRIBUTES}(?<=/)>|<(script|style|noscript|template|iframe|svg|textarea)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})>|<[!?][^>]*>|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S | re.I)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")

#: The end of a sentence, in any script, and quotes or brackets after it.
_SENTENCE = re.compile(r"[.!?\u2026\u3002\uff0e\uff01\uff1f\uff61\u061f\u06d4\u0964\u0965\u1362\u104b\u17d4\u0589][\"'\u00bb\u2019\u201c\u201d\u300d\u300f)\]\uff09]*$")

LINK_DENSITY = 0.5
LONG = 70
STOP_LOW, STOP_HIGH = 0.10, 0.18


def _marked(attributes: str) -> str | None:
    """The word of a class, id or role that marks a place, if there is one."""
    for m in _NAMED.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            words = re.split(r"[^a-z]+", name)
            if _HAVING.isdisjoint(words):
                for w in words:
                    if w in _MARKS:
                        return w
    return None


#: Why a block is bad: it is in an element of such a kind or a hidden one, or in one that a name marks.
FINE, BY_NAME, BY_KIND = 0, 1, 2


def _place(name: str, attributes: str, in_article: bool) -> int:
    if name in _ASIDE or (name == "header" and not in_article):
        return BY_KIND
    if name in ("html", "body", "main") or not attributes:
        return FINE
    if _HIDDEN.search(attributes):
        return BY_KIND
    mark = _marked(attributes)
    if mark is None:
        return FINE
    if name in _ARTICLE:  # an article may be a comment, but none is a menu
        return BY_KIND if mark in _REPLIES else FINE
    return BY_KIND if mark in _REPLIES else BY_NAME


class Block(NamedTuple):
    text: str
    links: int  # characters in links
    bad: bool  # by place
    article: int  # the number of its article, or 0
    entry: bool  # of a list


def blocks(page: str, layout: bool = False) -> list[Block]:
    """The blocks with text, in order. With ``layout``, names of what holds an article don't count in it."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, int, bool, int]] = []  # element, bad, article, silent, lists
    opened: Counter[str] = Counter()
    bad, article, silent, lists, links, articles = FINE, 0, False, 0, 0, 0

    def close() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            out.append(Block(text, len(_SPACE.sub(" ", html.unescape("".join(linked))).strip()), bad > FINE, article, lists > 0))
        parts.clear()
        linked.clear()

    for m in _TOKEN.finditer(page):
        name = m[3]
        if name is None:
            if m[1] is None and not silent:
                t = m[0]
                if t[0] != "<" or t == "<":
                    parts.append(t)
                    if links:
                        linked.append(t)
            continue
        name = name.lower()
        if name in _BLOCK:
            close()
            links = 0
        elif name == "br":
            parts.append(" ")
        if m[2]:
            if name == "a":
                links = 0
            elif opened[name]:
                while True:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == name:
                        break
                bad, article, silent, lists = stack[-1][1:] if stack else (FINE, 0, False, 0)
        elif name == "a":
            links = 1
        elif name in _NESTING and not m[4].rstrip().endswith("/"):
            if name == "body":  # an unclosed head ends here
                stack.clear()
                opened.clear()
                bad, article, silent, lists = FINE, 0, False, 0
            if name in _ARTICLE and not article:
                articles += 1
                article = articles
                lists = 0
                if layout and bad == BY_NAME:
                    bad = FINE
            bad = max(bad, _place(name, m[4], article > 0))
            silent = silent or name in _SILENT
            lists += name in _LISTS
            stack.append((name, bad, article, silent, lists))
            opened[name] += 1
    close()
    return out


def _foreign(text: str) -> bool:
    """Most letters are of no Latin script."""
    letters = [c for c in text if c.isalpha()]
    return sum(c > "\u024f" for c in letters) * 2 > len(letters)


def first_pass(b: Block) -> str:
    """good, bad, or undecided by length, stop words and links."""
    dense = b.links > LINK_DENSITY * len(b.text)
    if b.article:
        return "menu" if dense and b.entry else "good"
    if dense:
        return "bad"
    if len(b.text) < LONG:
        return "undecided"
    words = b.text.lower().split()
    stop = sum(_EDGE.sub("", w) in STOP_WORDS for w in words) / len(words)
    if stop >= STOP_HIGH or (not stop and _foreign(b.text)):
        return "good"
    return "undecided" if stop >= STOP_LOW else "bad"


def by_form(b: Block, sentences: bool) -> str:
    """The first pass without stop words: by links and length or, with ``sentences``, by the end of a sentence."""
    if b.links > LINK_DENSITY * len(b.text):
        return "bad"
    return "good" if len(b.text) >= LONG or (sentences and _SENTENCE.search(b.text)) else "undecided"


def second_pass(classes: list[str]) -> list[str]:
    """Undecided blocks with the class of the nearest decided one, good at equal distance, bad if there is none."""
    far = len(classes) + 1
    best = []
    for step in (1, -1):
        distance, last, seen = far, "bad", []
        for c in classes[::step]:
            distance += 1
            if c in ("good", "bad"):
                distance, last = 0, c
            seen.append((distance, last != "good", last))
        best.append(seen[::step])
    return [min(pair)[2] if c == "undecided" else c for c, *pair in zip(classes, *best, strict=True)]


def main_text(page: str | None) -> str:
    every = blocks(page or "")
    if all(b.bad for b in every if b.article) and any(b.article for b in every):
        every = blocks(page or "", layout=True)
    found = [b for b in every if not b.bad]
    inside = any(b.article for b in found)
    classes = [first_pass(b) for b in found]
    for sentences in (False, True):
        if not inside and "good" not in classes:
            classes = [by_form(b, sentences) for b in found]
    # an article is decided by itself, what is around it too
    around = iter(second_pass([c for c, b in zip(classes, found, strict=True) if not b.article]))
    classes = [c if b.article else next(around) for c, b in zip(classes, found, strict=True)]
    return "\n".join(b.text for c, b in zip(classes, found, strict=True) if c == "good")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each page: the id, the url, text (empty if none) and n_chars, its code points."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
