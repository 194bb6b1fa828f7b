"""Main text of a page by a maximum-scoring run of words and tags.

A page becomes a row of tokens. Words score positive and tags negative; a
linear scan finds the run with the highest sum, the article. The weights come
from labelled pages: pages that mark their article themselves tell how often a
tag, and a word in a given surrounding, lies in it and outside. Within the run,
elements that are no article text (menus, notices, forms, reader comments and
the like, by their name, role or class) are left out. One that holds most of the
page's words wraps the article and stays: forms, elements named by a class or
left open where they hold more words than remain without them, reader comments,
adverts and what lies outside of a marked article with ``OUTWEIGHS`` times as
many; adverts and their like inside a marked article never do. Elements left out score
0, tags and words alike, so a box between two paragraphs does not cut the run.

Where a page marks its article, and the mark holds at least half of the words
of the best run, tags inside it score 0 and its words, whatever surrounds
them, score positive, all other words at most 0: the run then covers what is
marked, with its lists, tables and captions.

The labelled pages are a bounded sample, ``SAMPLE_PAGES`` pages of at most
``SAMPLE_CHARS`` characters, the first by a hash of the page; fixed counts stand
in for what they do not show.

Text: character references are decoded, white space inside a block becomes one
space, blocks are joined in page order by one space. Elements of running text
(``a``, ``b``, ``span``...) do not part words; ``br`` and all others do.

Defined cases: null and empty pages have an empty text, and so have pages with
words only in closed menus, footers and other elements of ``NEVER``; pages are read whole,
broken and cut off markup as browsers would roughly read it; rows are handled
one by one, so repeated rows and null ids each get their row; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 300
SAMPLE_CHARS = 50_000

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(svg|math)(?=[\s/>])(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+(?<=/)>"
    r"|<(script|style|noscript|template|iframe|textarea|svg|math|object|select|title|xmp)"
    r"(?=[\s/>])(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+>.*?(?:</\2(?=[\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?",
                       re.I)

RUNNING = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label
mark q s samp small span strike strong sub sup time tt u var wbr""".split())
EMPTY = frozenset("""area base br col embed hr img input link meta param source track wbr""".split())
NEVER = frozenset("""head nav footer aside button menu dialog""".split())
SELDOM = frozenset({"form", "fieldset"})  # beside the article or around all of it
IN_HEAD = frozenset("""base basefont bgsound link meta noframes""".split())  # others open the body
ARTICLE = frozenset({"article", "main"})
# Parts of a class, id or role that name something beside the article.
BESIDE = frozenset("""ad ads advert advertisement adsense sponsor sponsored promo promotion banner
cookie cookies consent notice notification popup modal overlay newsletter subscribe subscription
signup login sidebar aside widget menu nav navbar navigation breadcrumb breadcrumbs toolbar
masthead topbar header footer copyright comments comment commentlist disqus replies respond share
sharing social related recommended recommendations pagination pager search""".split())
IN_ARTICLE_TOO = frozenset({"header", "search"})  # no sign against a part of the article
# Names such as no-comments, has-sidebar or ad-free tell of the page, not of the element.
STATE_FIRST = frozenset("""no non not has have is with without hide show""".split())
STATE_LAST = frozenset("""free open opened closed on off enabled disabled""".split())
# Names of what is hardly ever an article, and never inside of a marked one, however long.
ADVERTS = frozenset("""ad ads advert advertisement adsense sponsor sponsored promo promotion banner
cookie cookies consent notice notification newsletter subscribe subscription related recommended
recommendations share sharing social pagination pager breadcrumb breadcrumbs copyright""".split())
COMMENTS = frozenset("""comments comment commentlist disqus replies respond""".split())
OUTWEIGHS = 9  # times the other words, for what may well be longer than the article

# Stand in for labelled pages: seen so often inside and outside of an article.
PRIOR_IN = {name: 20 for name in "p h1 h2 h3 blockquote pre article".split()}
PRIOR_OUT = {name: 20 for name in "nav footer header form head title div".split()}
# Lists, tables and captions: their words mostly inside, unless they are links; their tags both.
STRUCTURE = "ul ol li dl dt dd table tbody thead tr td th caption figure figcaption".split()
STRUCTURE_IN, STRUCTURE_OUT = 20, 6


@dataclass
class Token:
    """A tag (``words`` is None) or a stretch of text in its surrounding."""

    key: str
    words: int | None = None
    text: str = ""
    beside: bool = False  # in an element that is no article text
    marked: bool = False  # inside the article as the page marks it
    parts: bool = False  # a tag that parts words


@dataclass
class Aside:
    """An element that looks as if it lay beside the article."""

    outer: Aside | None
    never: bool
    marked: bool
    factor: int
    own: int = 0  # words, but those of links and of elements of this kind inside
    words: int = 0  # with those inside
    wraps: bool = False  # holds the article, or a part of it


def _beside(name: str, attributes: str, in_article: bool) -> str:
    """"never" or "seldom" article text, an "advert", "comments" on it, or "" for all others."""
    if name in NEVER or (name == "header" and not in_article):
        return "never"
    found = "seldom" if name in SELDOM else ""
    if not attributes or name in ("html", "body", *ARTICLE):
        return found
    for attr, value in ATTRIBUTE.findall(attributes):
        attr, value = attr.lower(), value.strip("\"'").lower()
        if attr == "hidden" or attr == "aria-hidden" and value == "true":
            found = found or "seldom"
        for part in value.split():
            names = [x for x in re.split(r"[^a-z0-9]+", part) if x]
            if len(names) > 1 and (names[0] in STATE_FIRST or names[-1] in STATE_LAST):
                continue
            named = BESIDE.intersection(names) - (IN_ARTICLE_TOO if in_article else frozenset())
            if named & COMMENTS:
                return "comments"
            if named & ADVERTS:
                return "advert"
            found = found or ("seldom" if named else "")
    return found


def _find_wrappers(asides: list[Aside], free: dict[bool, int]) -> None:
    """Mark the elements that hold most words, largest first; what they hold counts as free.

    ``free`` has the words in no such element, inside the marked article and outside.
    """
    for e in reversed(asides):
        e.words += e.own
        if e.outer and not e.never:
            e.outer.words += e.words
    for e in sorted(asides, key=lambda e: -e.words):
        if e.never or e.outer and not e.outer.wraps:
            continue
        others = free[True] if e.marked else free[True] + free[False]
        factor = e.factor if e.marked or not free[True] else OUTWEIGHS
        if e.words > factor * others:
            e.wraps = True
            free[e.marked] += e.own


def tokens(html: str) -> list[Token]:
    """Tags and texts of a page in order, each text with its surrounding."""
    out: list[Token] = []
    inside: list[tuple[Token, Aside]] = []  # tags and texts in an element beside the article
    asides: list[Aside] = []
    free = {True: 0, False: 0}
    open_: list[tuple[str, Aside | None]] = []
    beside: list[Aside] = []
    article = link = 0
    block = "body"

    def add(token: Token) -> None:
        out.append(token)
        if beside:
            inside.append((token, beside[-1]))

    def text(part: str) -> None:
        plain = unescape(part)
        n = len(plain.split())
        if n and open_ and open_[-1][0] == "head":
            close(len(open_) - 1)
        token = Token(f"{block}{' link' if link else ''}", n, plain, False, article > 0)
        add(token)
        if not link:
            if beside:
                beside[-1].own += n
            else:
                free[article > 0] += n

    def close(depth: int, ended: bool = False) -> None:
        nonlocal article, link, block
        while len(open_) > depth:
            name, aside = open_.pop()
            if aside:
                beside.pop()
                if name != "head" and not aside.marked and not (ended and len(open_) == depth):
                    aside.never = False  # never ended, so it may have taken in the article
            article -= name in ARTICLE
            link -= name == "a"
        block = next((n for n, _ in reversed(open_) if n not in RUNNING), "body")

    at = 0
    for m in MARKUP.finditer(html):
        if m.start() > at:
            text(html[at:m.start()])
        at = m.end()
        name = (m[4] or m[7] or "").lower()
        if m[1] or m[2]:
            add(Token((m[1] or m[2]).lower(), marked=article > 0, parts=True))
        if not name:
            continue
        if m[3] or m[6]:
            depth = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), None)
            add(Token(f"/{name}", marked=article > 0, parts=name not in RUNNING))
            if depth is not None:
                close(depth, ended=True)
            continue
        if open_ and open_[-1][0] == "head" and name not in IN_HEAD:
            close(len(open_) - 1)  # the body starts, with or without a tag
        if name in ARTICLE and not article and beside:
            close(next((i for i, (_, aside) in enumerate(open_) if aside), len(open_)))
        elif name not in RUNNING and name != "br":
            depth = next((i for i in range(len(open_) - 1, -1, -1)
                          if open_[i][0] == "p" or open_[i][0] not in RUNNING), None)
            if depth is not None and open_[depth][0] == "p":
                close(depth)  # a paragraph ends where the next block starts
        if name not in EMPTY:
            aside, kind = None, _beside(name, m[5] or m[8] or "", article > 0)
            if kind:
                aside = Aside(beside[-1] if beside else None,
                              kind == "never" or kind == "advert" and article > 0, article > 0,
                              OUTWEIGHS if kind in ("comments", "advert") else 1)
                asides.append(aside)
                beside.append(aside)
            open_.append((name, aside))
            article += name in ARTICLE
            link += name == "a"
            if name not in RUNNING:
                block = name
        add(Token(name, marked=article > 0, parts=name not in RUNNING))
    if at < len(html):
        text(html[at:])
    close(0)

    _find_wrappers(asides, free)
    for token, aside in inside:
        token.beside = not aside.wraps
    return out


@dataclass(frozen=True)
class Weights:
    """Score of a tag, and of a word by its surrounding."""

    tags: dict[str, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=dict)
    tag: float = -math.log(2)
    word: float = math.log(2)

    def score(self, token: Token) -> float:
        if token.words is None:
            return self.tags.get(token.key, self.tag)
        return token.words * self.words.get(token.key, self.word)


def learn(pages: Iterable[str]) -> Weights:
    """Weights from pages that mark their article; others are skipped.

    With ``a`` counts inside and ``b`` outside, a word scores log(1 + r) and a
    tag -log(1 + 1 / r), r being (a + 1) / (b + 1): near 0 where it tells nothing.
    What lies in an element left out is not counted.
    """
    inside, outside = Counter(), Counter()
    for name, n in PRIOR_IN.items():
        inside.update({("tag", name): n, ("tag", f"/{name}"): n, ("word", name): n})
    for name, n in PRIOR_OUT.items():
        outside.update({("tag", name): n, ("tag", f"/{name}"): n, ("word", f"{name} link"): n})
    for name in STRUCTURE:
        inside.update({("tag", name): STRUCTURE_IN, ("tag", f"/{name}"): STRUCTURE_IN,
                       ("word", name): STRUCTURE_IN})
        outside.update({("tag", name): STRUCTURE_OUT, ("tag", f"/{name}"): STRUCTURE_OUT,
                        ("word", f"{name} link"): STRUCTURE_IN})
    for html in pages:
        found = tokens(html)
        if not any(t.marked for t in found):
            continue
        for t in found:
            if t.beside:
                continue
            side = inside if t.marked else outside
            if t.words is None:
                side["tag", t.key] += 1
            elif t.words:
                side["word", t.key] += t.words
    ratio = {k: (inside[k] + 1) / (outside[k] + 1) for k in inside | outside}
    return Weights({k: -math.log1p(1 / r) for (kind, k), r in ratio.items() if kind == "tag"},
                   {k: math.log1p(r) for (kind, k), r in ratio.items() if kind == "word"})


def best_run(scores: Iterable[float]) -> tuple[int, int]:
    """Start and end of the run with the highest sum; empty if no score is positive."""
    best = total = 0.0
    start, run = 0, (0, 0)
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, run = total, (start, i + 1)
    return run


def _word_count(found: Iterable[Token]) -> int:
    return sum(t.words or 0 for t in found if not t.beside)


def region(found: list[Token], weights: Weights) -> tuple[int, int]:
    """Start and end of the tokens that make up the article."""
    start, end = best_run(0.0 if t.beside else weights.score(t) for t in found)
    marked = [t for t in found if t.marked]
    if 2 * _word_count(marked) < max(1, _word_count(found[start:end])):
        return start, end

    def score(t: Token) -> float:
        if t.beside:
            return 0.0
        if t.marked:
            return 0.0 if t.words is None else t.words * math.log(2)
        return min(0.0, weights.score(t))

    return best_run(map(score, found))


def main_text(html: str | None, weights: Weights) -> str:
    found = tokens(html or "")
    start, end = region(found, weights)
    kept = []
    for t in found[start:end]:
        if t.words is None:
            if t.parts:
                kept.append(" ")
        elif not t.beside:
            kept.append(t.text)
    return " ".join("".join(kept).split())


def learn_weights(pages: DataFrame, html: str = "html") -> Weights:
    """Weights from a bounded sample of the pages that mark their article.

    The different pages of least hash: one number a page is sorted, and only the
    pages of the sample leave their task.
    """
    usable = (pages.select(F.col(html).alias("h"))
              .where(F.col("h").rlike("(?i)<(article|main)[ >]")
                     & (F.length("h") <= SAMPLE_CHARS)).withColumn("k", F.xxhash64("h")))
    last = (usable.select("k").distinct().orderBy("k").limit(SAMPLE_PAGES)
            .agg(F.max("k")).first()[0])
    if last is None:
        return learn([])
    sample = usable.where(F.col("k") <= last).groupBy("k").agg(F.min("h").alias("h")).orderBy("k")
    return learn(r.h for r in sample.collect())


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                 weights: Weights | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    fitted = learn_weights(pages, html) if weights is None else weights

    @F.pandas_udf("text string, n_chars long")
    def extract(sources: pd.Series) -> pd.DataFrame:
        texts = [main_text(h, fitted) for h in sources]
        return pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    return (pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"),
                         extract(F.col(html)).alias("x"))
            .select("page_id", "url", "x.*"))
