"""Main text of web pages by a maximum-scoring subsequence (operator 2).

A page becomes a sequence of words and tags.  Words score positive, tags
negative; words under elements that labelled pages show as boilerplate score as
much below zero as the labels say.  One linear scan finds the contiguous run of
highest score, the content region.  Inside the content element that holds most
of it (an article, a content column), if there is one, the region grows over all
words of positive score.  Words of boilerplate elements inside the region are
left out one by one, so a labelled inline element takes only its own words along.
An element with a boilerplate name that wraps the content is no boilerplate, nor
is a header inside it that holds the headline.  Clutter without any name goes by
its words: reader comments from their heading on, and short notices (cookies,
copyright) beside or at the edges of the content.

Weights come from ``labelled_pages``, small pages whose words are marked as
content or not: an element weighs the sum of the log odds of its tag and of the
words in its class, id and role (``fit_weights``), and a tag costs what finds
the marked words best (``fit_cost``).  Both take any other labelled pages too.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.plans.names import free_names

PIECES = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|noscript|template|svg|iframe|object|textarea|select|canvas|audio|video|annotation|annotation-xml)(?=[\s/>])(?:(?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+|[^>]*+)>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|(?P<text>[^<]++|<)", re.S | re.I)
#: Elements whose content is plain characters: the first end tag ends them.  The other raw ones nest.
CHARACTERS = frozenset("script style title noscript iframe textarea".split())
NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|itemprop|aria-label)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br td th math semantics mrow mi mo mn ms mtext mspace mstyle msup msub msubsup mfrac msqrt mroot mover munder munderover mfenced mpadded mphantom menclose".split())
#: A new one ends an open one of these.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Costs of a block tag that ``fit_cost`` tries; an inline tag costs a quarter.
COSTS = (0.1, 0.2, 0.4, 0.6, 0.9, 1.4)
#: A class such as ``has-sidebar`` or ``modal-open`` tells a state of the page, not what the element is.
STATES = frozenset("has no not with without is".split())
STATE_ENDS = frozenset("on off open closed ready enabled disabled".split())

#: Words that make a named header part of an article when they stand with it.
HEADLINE = frozenset("entry post article story page content title headline".split())
#: Notices that bear no telling name: what a short block at the edge of the content begins with.
NOTICE = re.compile(
    r"(?:we|this (?:web)?site|our (?:web)?site) uses? cookies\b|accept (?:all )?cookies\b|cookie (?:policy|settings|notice)\b|copyright (?:\(c\)|©|\d{4})|© ?\d{4}|\(c\) \d{4}"
    r"|subscribe to our\b|sign up (?:for|to) our\b|follow us on\b|skip to (?:main )?content\b", re.I)
#: Headings of reader comments.
COMMENTS = re.compile(r"(?:\d+ |no )?(?:reader )?(?:comments?|replies|responses)(?: \(?\d+\)?)?:?|leave a (?:reply|comment)|join the (?:discussion|conversation)|post a comment", re.I)


def is_notice(words: list[str]) -> bool:
    """A short block that only says what any page of the site says."""
    return len(words) <= 40 and bool(NOTICE.match(" ".join(words[:12])))


def labelled_pages() -> Iterator[tuple[str, str]]:
    """(html, main text): one page for each way to mark up content and each way to mark up boilerplate."""
    content = ["<article>", "<main>", '<div class="content">', '<div id="main-content">', '<div class="post">', '<div class="entry">', '<div class="story">',
               '<section class="text">', '<div class="article body">', '<div role="main">', '<div itemprop="articleBody">', '<div class="page">', '<div class="wrapper container">']
    clutter_tags = ["nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"]
    clutter_names = (
        "nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead topbar toolbar footer copyright legal colophon sidebar side rail widget "
        "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner notice notices cookie cookies consent gdpr alert warning popup modal overlay "
        "newsletter subscribe subscription signup login register search form comment comments commentlist discussion disqus reply replies respond reviews "
        "share sharing social follow related recommended recommendations trending popular pagination pager skip disclaimer toc tags complementary contentinfo dialog").split()
    body = "A first part of the story with some words in it"
    noise = "Some short words aside from it"
    for c in content:
        tag = re.match(r"<(\w+)", c)[1]
        for t in clutter_tags:
            yield f"<body>{c}<h1>{body}</h1><p>{body} <a>{body}</a> <b>{body}</b></p><ul><li>{body}</li></ul></{tag}><{t}><ul><li><a>{noise}</a></li></ul><p>{noise}</p></{t}></body>", body
        for name in clutter_names:
            yield f'<body><div class="{name}"><p>{noise}</p><ul><li><a>{noise}</a></li></ul></div>{c}<h2>{body}</h2><p>{body}</p><blockquote>{body}</blockquote></{tag}><section id="{name}">{noise}</section></body>', body


def unmarked_pages() -> Iterator[tuple[str, str]]:
    """(html, main text) of pages whose link lists bear no telling tag or name: they teach what a tag costs."""
    links = "<ul>" + "".join(f"<li><a href=x>{w}</a></li>" for w in "Home News Sport Culture Science Travel Contact".split()) + "</ul>"
    long = " ".join(["Many words make up a paragraph of the story and go on for a while"] * 3)
    for head in ("A headline of some words", "Two words"):
        for middle in (f"<p>{long}</p>", f"<p>Short.</p><p>{long}</p>", f"<ul><li>First of the points</li><li>Second of the points</li></ul><p>{long}</p>"):
            for wrap in ("div", "section"):
                text = " ".join(re.sub("<[^>]*>", " ", f"{head} {long} {middle}").split())
                yield f"<body><{wrap}>{links}</{wrap}><{wrap}><h1>{head}</h1><p>{long}</p>{middle}</{wrap}><{wrap}>{links}</{wrap}></body>", text


def _words_of(attrs: str) -> tuple[list[str], bool]:
    """Lower-case words of class, id, role and the like; whether the element is hidden."""
    names, hidden = [], False
    for key, a, b, c in NAMES.findall(attrs):
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
        elif key in ("class", "id", "role", "itemprop", "aria-label"):
            for token in value.split():
                parts = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", token)]
                if len(parts) < 2 or parts[0] not in STATES and parts[-1] not in STATE_ENDS:
                    names += parts
    return names, hidden


def _ends(html: str, raw: str) -> dict[int, int]:
    """Where the content of each closed element of this name begins, and where its end tag ends."""
    ends: dict[int, int] = {}
    opened: list[int] = []
    for m in re.finditer(rf"<(/?){raw}(?=[\s/>])(?:(?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+|[^>]*+)>", html, re.I):
        if not m[1]:
            if raw != "svg" or not m[0].endswith("/>"):
                opened.append(m.end())
        elif opened:
            ends[opened.pop()] = m.end()
    return ends


def _pieces(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, tag or text, attributes); kinds: open, close, text.

    Raw elements are left out whole.  One that is never closed is left out to
    the end of the page if it is a script or style, else only its tag is.
    """
    at, known, unclosed = 0, {}, set()
    while at < len(html):
        m = PIECES.match(html, at)
        at = m.end()
        if m["text"] is not None:
            yield "text", m["text"], ""
        elif m["tag"] is not None:
            yield ("close" if m["end"] else "open"), m["tag"].lower(), m["attrs"]
        elif m["tag2"] is not None:
            yield ("close" if m["end2"] else "open"), m["tag2"].lower(), m["attrs2"]
        elif m["raw"] is not None:
            raw = m["raw"].lower()
            if raw not in CHARACTERS:
                if raw not in known:
                    known[raw] = _ends(html, raw)
                at = known[raw].get(at, at)
            elif raw not in unclosed:
                end = re.compile(rf"</{raw}(?=[\s/>])[^>]*+>", re.I).search(html, at)
                if end:
                    at = end.end()
                elif raw in ("script", "style"):
                    return
                else:
                    unclosed.add(raw)


def fit_weights(pages: Iterable[tuple[str, str]]) -> dict[str, float]:
    """Log odds that a word under an element of this tag or name is content."""
    inside, outside = Counter(), Counter()
    for html, gold in pages:
        stack: list[tuple[str, list[str]]] = []
        for kind, what, attrs in _pieces(html):
            if kind == "open" and what not in VOID:
                stack.append((what, [f"<{what}>", *_words_of(attrs)[0]]))
            elif kind == "close" and any(t == what for t, _ in stack):
                while stack.pop()[0] != what:
                    pass
            elif kind == "text" and what.strip():
                count = inside if what.strip() in gold else outside
                for feature in {f for _, fs in stack for f in fs}:
                    count[feature] += len(what.split())
    return {f: max(-4.0, min(2.0, math.log((inside[f] + 1) / (outside[f] + 1)))) for f in {*inside, *outside}}


class Elements:
    """The elements of one page by number, parents first; 0 is the page."""

    def __init__(self):
        self.parent, self.mark, self.words, self.tag = [0], [0.0], [0], [""]
        self.holds, self.article, self.main, self.hidden, self.clutter, self.by_tag = [False], [False], [False], [False], [False], [False]

    def add(self, parent: int, tag: str, mark: float, named: bool, hidden: bool, clutter: bool, by_tag: bool) -> int:
        """A new element: ``mark`` is its boilerplate weight or 0; ``clutter`` tells a boilerplate name, also on an article."""
        self.parent.append(parent)
        self.mark.append(mark)
        self.words.append(0)
        self.tag.append(tag)
        self.holds.append(tag in ("article", "main") or named and tag not in ("html", "body"))
        self.article.append(self.article[parent] or tag in ("article", "main"))
        self.main.append(tag == "main")
        self.hidden.append(hidden)
        self.clutter.append(clutter)
        self.by_tag.append(by_tag)
        return len(self.parent) - 1

    def within(self, element: int, outer: int) -> bool:
        """Whether an element is another one or lies inside it."""
        while element > outer:
            element = self.parent[element]
        return element == outer

    def _inherit(self) -> list[float]:
        bad = [0.0]
        for p, mark in zip(self.parent[1:], self.mark[1:]):
            bad.append(min(bad[p], mark))
        return bad

    def boilerplate(self) -> list[float]:
        """Each element's boilerplate weight or 0, inherited except from wrappers of the content.

        A wrapper is an element, not hidden, with a boilerplate name that holds
        a main, or one of the page's longest articles, or, by its name only,
        most of the page's words.  The last two give way to content that is
        marked up as such elsewhere: comments stay boilerplate beside it.
        """
        bad = self._inherit()
        if not any(self.mark):
            return bad
        inside, most, main = list(self.words), [0] * len(bad), [False] * len(bad)
        for i in range(len(bad) - 1, 0, -1):
            p = self.parent[i]
            inside[p] += inside[i]
            if self.hidden[i]:
                continue
            is_main = self.main[i] and not self.clutter[i] and inside[i] > 0
            is_article = self.article[i] and not self.article[p] and not self.clutter[i]
            main[p] = main[p] or main[i] or is_main
            most[p] = max(most[p], most[i], inside[i] if is_article else 0)
        clean = sum(n for n, b in zip(self.words, bad) if not b)
        beside = max((inside[i] for i in range(1, len(bad)) if self.holds[i] and not bad[i]), default=0)
        for i in range(1, len(bad)):
            if self.mark[i] and not self.hidden[i]:
                article = most[i] > beside and 2 * most[i] >= most[0] and 2 * clean <= inside[0]
                bulk = 2 * inside[i] > inside[0] and not beside and not self.by_tag[i]
                if main[i] or article or bulk:
                    self.mark[i] = 0.0
        return self._inherit()


def best_run(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous run of highest sum, the first of equal ones; (0, 0) if no sum is above 0."""
    best, total, begin, span = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, span = total, (begin, i + 1)
    return span


class Extractor:
    """Weights ready for use; ``text`` gives a page's main text."""

    def __init__(self, weights: dict[str, float], cost: float):
        # Tags on both sides of the labels say little: only clear ones count.
        self.weights = {f: w for f, w in weights.items() if abs(w) >= 1.5 and f not in ("<body>", "<div>", "<section>", "<p>", "<ul>", "<li>", "<a>", "<h1>", "<h2>", "<b>", "<blockquote>")}
        self.block_cost, self.inline_cost = -cost, -cost / 4

    def text(self, html: str | None) -> str:
        if not html:
            return ""
        page = Elements()
        stack: list[tuple[str, int]] = [("", 0)]  # tag, number of the element; one without a name goes by its parent's
        blocks: list[tuple[list[tuple[str, int]], tuple]] = []  # pieces with their elements; elements that may hold content
        tokens: list[float] = []  # words, or the cost of a tag
        within: list[int] = []  # element of each token's words
        owner: list[int] = []  # block of each token's words, -1 for tags
        waiting: set[int] = set()  # elements named header inside the content that hold no headline yet
        fresh = True
        for kind, what, attrs in _pieces(html):
            if kind == "text":
                text = unescape(what)
                words = len(text.split())
                if words or not fresh:
                    if fresh:
                        blocks.append(([], tuple(dict.fromkeys(e for _, e in stack if page.holds[e]))))
                        fresh = False
                    blocks[-1][0].append((text, stack[-1][1]))
                    if words:
                        page.words[stack[-1][1]] += words
                        tokens.append(words)
                        within.append(stack[-1][1])
                        owner.append(len(blocks) - 1)
                continue
            inline = what in INLINE
            if not inline:
                fresh = True
            tokens.append(self.inline_cost if inline else self.block_cost)
            within.append(0)
            owner.append(-1)
            if what in ("br", "td", "th", "img") and not fresh:
                blocks[-1][0].append((" ", stack[-1][1]))
            if kind == "open":
                if what in VOID:
                    continue
                names, hidden = _words_of(attrs) if attrs else ((), False)
                if inline and not names and not hidden:
                    stack.append((what, stack[-1][1]))
                    continue
                if not inline:
                    while stack[-1][0] == "p" or stack[-1][0] in CLOSES.get(what, ()):
                        stack.pop()
                tag_weight = self.weights.get(f"<{what}>", 0.0)
                if what == "header" and any(page.article[e] for _, e in stack):
                    tag_weight = 0.0  # an article's own header holds its headline
                total = tag_weight + sum(self.weights.get(n, 0.0) for n in names)
                inside = any(page.holds[e] for _, e in stack)
                headed = inside and "header" in names and total - self.weights.get("header", 0.0) * names.count("header") >= 0
                if headed and not HEADLINE.isdisjoint(names):
                    total -= self.weights.get("header", 0.0) * names.count("header")
                    headed = False
                if what in ("h1", "h2"):
                    for e in waiting.intersection(e for _, e in stack):  # a header that holds a headline
                        page.mark[e], page.clutter[e] = (-4.0 if page.hidden[e] else 0.0), False
                clutter = total < 0
                mark = min(total, -1.0) if clutter and what not in ("html", "body", "article", "main") else -4.0 if hidden else 0.0
                stack.append((what, page.add(stack[-1][1], what, mark, total > 0, hidden, clutter, tag_weight < 0)))
                if headed:
                    waiting.add(stack[-1][1])
            else:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == what), 0)
                # A stray inline end does not close the blocks around it.
                if depth and (not inline or all(t in INLINE for t, _ in stack[depth:])):
                    del stack[depth:]

        bad = page.boilerplate()
        low, high = best_run([t if b < 0 else t * (bad[e] or 1.0) for t, b, e in zip(tokens, owner, within)])
        chosen = sorted({b for b, e in zip(owner[low:high], within[low:high]) if b >= 0 and not bad[e]})
        if not chosen:
            return ""
        good = ["".join(t for t, e in pieces if not bad[e]).split() for pieces, _ in blocks]
        # The outermost content element that holds most of the region's words.
        held = Counter()
        for b in chosen:
            for h in blocks[b][1]:
                if not bad[h]:
                    held[h] += len(good[b])
        whole = sum(len(good[b]) for b in chosen)
        wide = [h for h, n in held.items() if 2 * n > whole]
        if wide:
            region = set(chosen)
            chosen = [i for i, (_, holders) in enumerate(blocks) if i in region or min(wide) in holders]
        chosen = self._without_notices(page, blocks, good, [b for b in chosen if good[b]], min(wide, default=0))
        return "\n\n".join(" ".join(good[b]) for b in chosen if good[b])


    def _without_notices(self, page: Elements, blocks: list, good: list[list[str]], chosen: list[int], holder: int) -> list[int]:
        """The chosen blocks but for clutter that bears no name: comments from their heading on, notices beside or at the edges of the content."""
        kept, until = [], 0
        for b in chosen:
            element = blocks[b][0][0][1]
            if until and page.within(element, until):
                continue
            until = 0
            if kept and page.tag[element] in HEADINGS - {"h1"} and COMMENTS.fullmatch(" ".join(good[b])):
                until = page.parent[element]  # the rest of the element that the heading stands in
                continue
            kept.append(b)
        if holder:
            kept = [b for b in kept if holder in blocks[b][1] or not is_notice(good[b])]
        low, high = 0, len(kept)
        while low < high and is_notice(good[kept[low]]):
            low += 1
        while high > low and is_notice(good[kept[high - 1]]):
            high -= 1
        return kept[low:high] or chosen  # a page of notices only keeps them


def fit_cost(pages: Iterable[tuple[str, str]], weights: dict[str, float]) -> float:
    """The cost of a block tag that finds the words of labelled pages best (F1), the middle one of the best."""
    gold = [(html, Counter(text.split())) for html, text in pages]

    def quality(cost: float) -> float:
        extract, share = Extractor(weights, cost).text, 0.0
        for html, want in gold:
            got = Counter(extract(html).split())
            share += 2 * (got & want).total() / max(1, got.total() + want.total())
        return round(share / max(1, len(gold)), 6)

    found = {c: quality(c) for c in COSTS}
    best = [c for c in COSTS if found[c] == max(found.values())]
    return best[len(best) // 2]


@cache
def learned() -> tuple[dict[str, float], float]:
    """Weights and cost from the labelled pages of this module."""
    weights = fit_weights(labelled_pages())
    return weights, fit_cost(unmarked_pages(), weights)


def main_text(pages: DataFrame, html_col: str = "html", text_col: str = "text", weights: dict[str, float] | None = None, cost: float | None = None) -> DataFrame:
    """``pages`` with the main text of each whole page in ``text_col`` (replaced if there).

    Null and empty pages, and pages without content words, give an empty text.
    Of equally good regions the first counts.  Each row is read by itself, so
    repeated pages and null ids are as any other; a page of any length is read
    whole, in time in proportion to its length.  All other columns pass through,
    whatever their names; an empty table gives an empty result.  Nothing is
    shuffled.
    """
    found, fitted = learned()
    ready = found if weights is None else weights, fitted if cost is None else cost
    pages = pages.drop(text_col) if text_col != html_col else pages
    read, made = free_names(pages, "__html", "__main")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Extractor(*ready).text
        for batch in batches:
            texts = pa.array([extract(h) for h in batch.column(len(batch.columns) - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*batch.schema.names[:-1], made])

    shape = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields], f"`{made}` string"])
    out = pages.withColumn(read, F.col(html_col).cast("string")).mapInArrow(run, shape)
    return (out.drop(text_col) if text_col == html_col else out).withColumnRenamed(made, text_col)
