"""Article text of fetched pages: every candidate measured by sums over the page, the densest cut out.

A page is read once, in time linear in its length, into its visible text (white space runs as one
space) and elements, each of which is an interval of that text. What density needs (sentences,
numbers, phrases, paragraphs) is found once for the whole text and kept as running sums, so that a
candidate is measured from its two ends and never copied; nested elements of one interval are
measured once. Only the chosen text leaves the task; Spark's columns measure it again and give its
status. Numbers and phrases count where they lie inside an interval whole.

Null or empty html: empty text. Markup that never ends takes the rest; unclosed and stray tags are
closed as browsers do (a paragraph ends at the next block). Repeated rows each give one. Other
columns are not read. Empty table: empty.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.functions.documents import NUMBERS, density
from casework.functions.pages import BOILERPLATE, HARD, MENU, extraction_status, paragraphs

# Where articles stand, in order; what is never part of one. A name is a tag, .class, #id or [attribute=value].
PLACES = (
    "article [role=main] main [itemprop=articleBody] .article-body .article__body .article__content-body .ArticleBody-articleBody .richtext .post-content .entry-content .story-body .story-body__inner .story-content .story-text "
    ".article-content .article-text .article-copy .article_body .article__content .content-body .body-content .post-body .news-article .newsArticle #article #main [data-component=text] .content__body .bw-release-story .bw-press-release-story "
    "#release-body .release-body .prnews-paragraph [data-component=article-body] .c-article__body .a-article-body #story #content"
).split()
STRIPPED = (
    "script style nav header footer aside noscript iframe figcaption .ad .ads .advertisement .ad-container .social-share .share-buttons .share-bar .related-articles .related-links .related .newsletter .newsletter-signup .sidebar .widget .widget-area "
    ".popup .modal .overlay .breadcrumb .breadcrumbs .tags .tag-list .article-tags .comments .comment-section .promo .teaser-list .rec-list [aria-label=Advertisement] [data-testid=ad-unit]"
).split()
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Blocks that end an open paragraph.
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
LONGEST = 20_000

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_ENDS = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?+")
_SAID = re.compile(r"(?<=[.!?])\s+")
_STOPS = re.compile("[.!?]+")
_NUMBERS = re.compile(NUMBERS, re.I | re.A)
_KEYS = {n[1 : n.index("=")] for n in PLACES + STRIPPED if n[0] == "["}
_NAMES = frozenset(PLACES) | frozenset(STRIPPED)
_HIDES = frozenset(STRIPPED)


def _tags(page: str):
    """(start, end, closing, tag, attributes) of each piece of markup; tag is empty for comments, raw text of scripts comes as attributes."""
    at, n = 0, len(page)
    last = {q: page.rfind(q) for q in "\"'"}
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            yield start, at, "", "", ""
        elif page[start + 1 : start + 2] in ("!", "?"):
            end = page.find(">", start)
            at = n if end < 0 else end + 1
            yield start, at, "", "", ""
        elif m := _NAME.match(page, start + 1):
            i = m.end()
            while (e := _ENDS.search(page, i)) and e[0] != ">":  # a quote hides a > where it is closed
                i = page.find(e[0], e.end()) + 1 if e.start() < last[e[0]] else e.end()
            if not e:
                yield start, n, "", "", ""
                return
            at = e.end()
            tag = m[2].lower()
            yield start, at, m[1], tag, page[m.end() : e.start()]
            if not m[1] and tag in ("script", "style"):
                close = re.compile(f"</{tag}", re.I | re.A).search(page, at)
                end = n if close is None else close.start()
                yield at, end, "", "", page[at:end]
                at = end
        else:
            at = start + 1


class Text:
    """A text whose intervals are measured from running sums."""

    def __init__(self, text: str, blocks: list[tuple[int, int]] | None = None):
        self.text = text
        low = text.lower()
        low = low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        self.phrases = {p: at for p in {*BOILERPLATE, *HARD, *MENU} if (at := _places(low, p))}
        self.stock, self.hard, self.menu = ([p for p in of if p in self.phrases] for of in (BOILERPLATE, HARD, MENU))
        spans = [m.span() for m in _SAID.finditer(text)]
        self.cut, self.next = [a for a, _ in spans], [b for _, b in spans]
        sizes = [b - a for a, b in zip([0, *self.next], [*self.cut, len(text)])]
        self.long = list(accumulate((x > 30 for x in sizes), initial=0))
        self.total = list(accumulate((x if x > 30 else 0 for x in sizes), initial=0))
        stops = [m.span() for m in _STOPS.finditer(text)]
        self.stop, self.after = [a for a, _ in stops], [b for _, b in stops]
        self.told = list(accumulate((self._trimmed(a, b) > 15 for a, b in zip([0, *self.after], [*self.stop, len(text)])), initial=0))
        found = [m.span() for m in _NUMBERS.finditer(text)]
        self.number, self.number_end = [a for a, _ in found], [b for _, b in found]
        # paragraphs of a text that is a join of them; else each interval is one
        self.blocks = None if blocks is None else [a for a, _ in blocks]
        self.real = None if blocks is None else list(accumulate((b - a >= 80 and bool(_STOPS.search(text, a, b)) for a, b in blocks), initial=0))

    def _trimmed(self, a: int, b: int) -> int:
        while a < b and self.text[a].isspace():
            a += 1
        while a < b and self.text[b - 1].isspace():
            b -= 1
        return b - a

    def _has(self, phrase: str, s: int, e: int) -> bool:
        at = self.phrases[phrase]
        i = bisect_left(at, s)
        return i < len(at) and at[i] + len(phrase) <= e

    def count(self, phrases: list[str], s: int, e: int) -> int:
        return sum(self._has(p, s, e) for p in phrases)

    def density(self, s: int, e: int) -> int:
        """0 to 90, as the column of this name gives for the interval's text; intervals begin and end with no white space."""
        n = e - s
        if n < 50:
            return 0
        i, j = bisect_right(self.cut, s), bisect_left(self.cut, e)
        if i >= j:
            long_, total = (1, n) if n > 30 else (0, 0)
        else:  # whole sentences between the first cut and the last, and the two at the ends
            ends = [x for x in (self.cut[i] - s, e - self.next[j - 1]) if x > 30]
            long_, total = self.long[j] - self.long[i + 1] + len(ends), self.total[j] - self.total[i + 1] + sum(ends)
        mean = total / long_ if long_ else 0
        a, b = bisect_left(self.number, s), bisect_right(self.number_end, e)
        stock = self.count(self.stock, s, e)
        if self.blocks is None:
            k = bisect_left(self.stop, s)
            inside = (k < len(self.stop) and self.stop[k] < e) or (k > 0 and self.after[k - 1] > s)
            real = int(n >= 80 and inside and not stock)
        else:
            real = self.real[bisect_left(self.blocks, e)] - self.real[bisect_left(self.blocks, s)]
        points = next((p for least, p in ((2000, 30), (1000, 20), (600, 12), (300, 5)) if n >= least), 0) + next((p for least, p in ((80, 30), (50, 20), (30, 10)) if mean >= least), 0)
        points += min(20, 5 * real) + min(10, 2 * max(0, b - a))
        if stock >= 2 or self.count(self.hard, s, e):
            points = max(0, points - 40)
        return max(0, points - 30) if self._is_menu(s, e) else points

    def _is_menu(self, s: int, e: int) -> bool:
        n, found = e - s, self.count(self.menu, s, e)
        if found >= 4 and n < 1500 or found * 500 > n * 3:
            return True
        if n <= 400:
            return False
        i, j = bisect_right(self.after, s), bisect_left(self.stop, e)
        if i >= j:
            return True
        said = self.told[j] - self.told[i + 1] + (self._trimmed(s, self.stop[i]) > 15) + (self._trimmed(min(e, self.after[j - 1]), e) > 15)
        return said < 2


def _places(low: str, phrase: str) -> list[int]:
    out, at = [], low.find(phrase)
    while at >= 0:
        out.append(at)
        at = low.find(phrase, at + 1)
    return out


class Page:
    """Visible text and elements (tag, names, start, end) of a page, in order; stripped elements are left out."""

    def __init__(self, page: str):
        self.json: list[str] = []
        texts: list[str] = []
        elements: list[list] = []
        stack: list[tuple[str, int, bool]] = []  # tag, element or -1, hides
        open_: dict[str, int] = {}
        size = hidden = 0
        in_json, last = False, 0

        def close(depth: int) -> None:
            nonlocal hidden
            for tag, k, hides in stack[depth:]:
                open_[tag] -= 1
                hidden -= hides
                if k >= 0:
                    elements[k][3] = size
            del stack[depth:]

        for start, end, closing, tag, attributes in (*_tags(page), (len(page), len(page), "", "", "")):
            if start > last and not hidden:
                texts.append(entities.unescape(page[last:start]))
                size += len(texts[-1])
            last = end
            if not tag:
                if in_json and attributes:
                    self.json.append(attributes)
                in_json = False
                continue
            if closing:
                if open_.get(tag):
                    close(next(d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == tag))
                continue
            values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
            in_json = tag == "script" and values.get("type", "").lower() == "application/ld+json"
            if tag in BLOCKS and open_.get("p"):
                close(next(d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == "p"))
            if tag in VOID:
                continue
            names = {tag, f"#{values.get('id', '')}", *(f".{c}" for c in values.get("class", "").split()), *(f"[{k}={values[k]}]" for k in _KEYS & values.keys())} & _NAMES
            hides = not names.isdisjoint(_HIDES)
            hidden += hides
            if not hidden:
                elements.append([tag, names, size, None])
            stack.append((tag, -1 if hidden else len(elements) - 1, hides))
            open_[tag] = open_.get(tag, 0) + 1
        close(0)
        raw = "".join(texts)
        runs = [m.span() for m in re.finditer(r"\s+", raw)]
        starts, less = [a for a, _ in runs], list(accumulate((b - a - 1 for a, b in runs), initial=0))
        self.text = re.sub(r"\s+", " ", raw)

        def place(x: int) -> int:
            i = bisect_left(starts, x)  # runs that begin before x
            return x - less[i] if not i or runs[i - 1][1] <= x else starts[i - 1] - less[i - 1] + 1

        self.elements = [(tag, names, *self.trim(place(a), place(b))) for tag, names, a, b in elements]

    def trim(self, a: int, b: int) -> tuple[int, int]:
        a += self.text[a : a + 1] == " " and a < b
        b -= b > a and self.text[b - 1] == " "
        return a, b


def _told(parts: list[str]) -> list[str]:
    """Bodies or descriptions of linked data blocks, over 300 characters, in order."""
    out = []
    for raw in parts:
        try:
            data = json.loads(raw)
        except (ValueError, RecursionError):
            continue
        for x in data if isinstance(data, list) else [data]:
            if isinstance(x, dict):
                text = max((str(x.get(k) or "") for k in ("articleBody", "article:body", "description")), key=len)
                if len(text) > 300:
                    out.append(text)
    return out


class Joined:
    """Chosen paragraphs of a page as one text; those inside an element are an interval of it."""

    def __init__(self, page: Page, spans: list[tuple[int, int]]):
        self.starts = [a for a, _ in spans]
        self.at, n = [], 0
        for a, b in spans:
            self.at.append((n, n + b - a))
            n += b - a + 2
        self.text = Text("\n\n".join(page.text[a:b] for a, b in spans), self.at)

    def inside(self, s: int, e: int) -> tuple[int, int, int]:
        """(how many, start, end) of the paragraphs that begin inside an element."""
        i, j = bisect_left(self.starts, s), bisect_left(self.starts, e)
        return (j - i, self.at[i][0], self.at[j - 1][1]) if i < j else (0, 0, 0)


def article_of(html: str | None, every: bool = True) -> tuple[str, str]:
    """(text, label): from linked data, usual places, all paragraphs, the densest block, or all text; a later step only where the earlier ones gave little.

    Each element of a usual place is tried; with every=False, the first of each alone.
    """
    page = Page(html or "")
    whole = Text(page.text)
    paras = [(a, b) for tag, _, a, b in page.elements if tag == "p"]
    all_starts = [a for a, _ in paras]
    clean = [(a, b) for a, b in paras if b - a > 50 and not whole.count(whole.stock, a, b)]
    stop = lambda a, b: bool(_STOPS.search(page.text, a, b))
    usual = Joined(page, clean)
    best, chosen, label = 0, (Text(""), 0, 0), "none"
    for told in _told(page.json):
        if len(told) > chosen[2] - chosen[1]:
            own = Text(told, None)
            chosen, label, best = (own, 0, len(told)), "json-ld", density_of(told)
            if len(told) >= 2000 and best >= 40:
                break
    size = lambda: chosen[2] - chosen[1]
    measured: dict[tuple, int] = {}

    def measure(text: Text, s: int, e: int) -> int:
        k = (id(text), s, e)
        if k not in measured:
            measured[k] = text.density(s, e)
        return measured[k]

    if size() < 1000 or best < 30:
        of: dict[str, list[tuple[int, int]]] = {}
        for _, names, a, b in page.elements:
            for name in names:
                of.setdefault(name, []).append((a, b))
        done = False
        for name in PLACES:
            for a, b in of.get(name, ()) if every else of.get(name, ())[:1]:
                n, s, e = usual.inside(a, b)
                text = usual.text
                if bisect_left(all_starts, b) - bisect_left(all_starts, a) < 2 or e - s < 300:
                    text, s, e = whole, a, b
                if e - s > 250 and (d := measure(text, s, e)) > best:
                    best, chosen, label = d, (text, s, e), name
                    if done := best >= 60 and e - s >= 1500:
                        break
            if done:
                break
    if best < 40:
        long_ = Joined(page, [(a, b) for a, b in clean if b - a >= 60 and stop(a, b) and page.text.count(" ", a, b) >= 7])
        if len(long_.at) >= 2 and (d := long_.text.density(0, len(long_.text.text))) > best:
            best, chosen, label = d, (long_.text, 0, len(long_.text.text)), "p-aggregate"
    if best < 35 or size() < 600:
        ended = Joined(page, [(a, b) for a, b in clean if stop(a, b)])
        for a, b in dict.fromkeys((a, b) for tag, _, a, b in page.elements if tag in ("div", "section", "article")):
            if b - a < 300 or whole.count(whole.menu, a, b) > 5:
                continue
            n, s, e = ended.inside(a, b)
            text = ended.text
            if n < 2:
                text, s, e = whole, a, b
            if e - s > 400 and (d := measure(text, s, e)) > best:
                best, chosen, label = d, (text, s, e), "div-density"
    if size() < 200:
        a, b = page.trim(0, len(page.text))
        chosen, label = (whole, a, b), "body"
    return chosen[0].text[chosen[1] : chosen[2]], label


def density_of(text: str) -> int:
    """The density of a text that is no interval of a page: paragraphs are between empty lines."""
    spans, at = [], 0
    for part in re.split(r"(\n\n+)", text):
        lead = len(part) - len(part.lstrip())
        if not part.startswith("\n\n") and not any(p in part.lower() for p in BOILERPLATE):
            spans.append((at + lead, at + lead + len(part.strip())))
        at += len(part)
    lines = [x for line in text.split("\n") if (x := line.strip())]
    t = Text(text, spans)
    d = t.density(0, len(text))
    short = sum(len(x) < 40 for x in lines)
    return max(0, d - 30) if len(lines) > 5 and short > 0.6 * len(lines) and not t._is_menu(0, len(text)) else d


def articles(pages: DataFrame, every: bool = True) -> DataFrame:
    """(page_id, text, label, density, n_chars, n_paragraphs, status) of pages (page_id, html); texts end after 20,000 characters, the field's length."""

    def read(htmls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([article_of(h if isinstance(h, str) else None, every) for h in htmls], columns=["text", "label"], dtype=object)

    a = pages.select("page_id", F.pandas_udf(read, "text string, label string")(F.col("html")).alias("a"))
    a = a.select("page_id", F.substring("a.text", 1, LONGEST).alias("text"), "a.label", F.coalesce(density(F.col("a.text")), F.lit(0)).cast("int").alias("density"))
    return a.select("*", F.length("text").alias("n_chars"), paragraphs(F.col("text")).alias("n_paragraphs"), extraction_status(F.col("text"), F.col("density")).alias("status"))
