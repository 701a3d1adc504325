"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree.

A page is read into a tree of elements. Every element gets features of its subtree (text, links,
density, marks, forms), of its attribute tokens, of its depth and of its siblings. Gradient-boosted
trees give it the chances of three roles: content, chrome (menus, headers, footers, sidebars,
notices, adverts, forms, comments) and frame (holds both). Decoding takes the likeliest roles of
the whole tree under the rule that a frame may hold anything, content may hold chrome, and chrome
holds nothing else, with a price for each change on the way down; so an ancestor and a descendant
never contradict each other. The text of content nodes is joined: character references decoded,
white space in a block one space, blocks in page order with one space between.

The trees are fitted on pages that a generator makes from a few hundred random layouts with known
roles (``TRAIN_PAGES``, a fixed number), so no labels of the table are needed.

Null or empty html, or no content: empty text. Repeated rows: one result each. Unclosed and stray
tags are taken as browsers do. Very long pages are read whole, in time linear in their length; their
elements are judged ``ELEMENTS`` at a time, so that a task holds about 300 bytes for each element and not its
whole row of features. Other columns are not read and keep their names; one named as the result is replaced. Empty table: empty.
One map, no shuffle.
"""

from __future__ import annotations

import functools
import html as entities
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 420
#: Elements whose whole feature rows (about 500 bytes each) are held at once.
ELEMENTS = 20_000
ROUNDS, DEPTH, RATE, BINS = 24, 4, 0.25, 32
CONTENT, CHROME, FRAME = 0, 1, 2
#: What a change of role on the way down costs, in log chances.
CHANGE = 2.0

# Element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template head title svg iframe object select option textarea button canvas math audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
TAGS = "html body main article section div p span a b li ul ol table tr td th h1 h2 h3 h4 nav header footer aside form blockquote pre figure figcaption dl dd dt em i strong time label address".split()
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
BLOCK_CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
STOPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
# Words in attributes: of content, of chrome.
GOOD_WORDS = "article content main post entry story body text page blog news detail".split()
BAD_WORDS = (
    "ad ads advert advertisement banner promo sponsor sponsored nav navbar navigation menu header masthead footer foot sidebar side aside rail cookie cookies consent gdpr notice alert warning disclaimer copyright "
    "comment comments reply replies discussion disqus related recommended more popular trending share sharing social follow subscribe newsletter signup login form search breadcrumb breadcrumbs widget popup modal overlay tag tags meta byline author toolbar skip legal links"
).split()

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_ENDS = re.compile(r"[>\"']")
_NAMED = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in ("script", "style")}


def markup(html: str):
    """(start, end, closing, name, attributes) of each piece of markup, in order, in linear time; name is None for comments and such.

    Quotes hide a > in attributes where they are closed. Markup that never ends takes the rest, as in browsers.
    """
    at, n = 0, len(html)
    last = {q: html.rfind(q) for q in "\"'"}
    while (start := html.find("<", at)) >= 0:
        if html.startswith("<!--", start):
            end = html.find("-->", start + 2)
            at = n if end < 0 else end + 3
            yield start, at, "", None, ""
        elif html[start + 1 : start + 2] in ("!", "?"):
            end = html.find(">", start)
            at = n if end < 0 else end + 1
            yield start, at, "", None, ""
        elif m := _NAME.match(html, start + 1):
            i = m.end()
            while (e := _ENDS.search(html, i)) and e[0] != ">":
                i = html.find(e[0], e.end()) + 1 if e.start() < last[e[0]] else e.end()
            if not e:
                at = n
                yield start, n, "", None, ""
                continue
            at = e.end()
            if not m[1] and m[2].lower() in _RAW_END:  # what they hold is no markup
                end = _RAW_END[m[2].lower()].search(html, at)
                at = n if end is None or (close := html.find(">", end.end())) < 0 else close + 1
            yield start, at, m[1], m[2], html[m.end() : e.start()]
        else:  # a < of the text
            at = start + 1


class Page:
    """Elements in page order: tag, attribute words, parent; and texts with the element that holds each."""

    def __init__(self, html: str):
        self.tag, self.words, self.parent = ["html"], [()], [-1]
        self.texts: list[tuple[int, str]] = []
        stack, at = [0], 0
        unseen = 0  # how many open elements hide their text
        count: dict[str, int] = {}  # open elements by tag

        def close(depth: int) -> None:
            nonlocal unseen
            for x in stack[depth:]:
                unseen -= self.tag[x] in UNSEEN
                count[self.tag[x]] -= 1
            del stack[depth:]

        for start, end, closing, name, attributes in (*markup(html), (len(html), len(html), "", None, "")):
            if start > at and not unseen:
                self.texts.append((stack[-1], html[at:start]))
            at = end
            if not name:
                continue
            tag = name.lower()
            if closing:
                if tag in ("html", "body"):
                    continue
                if count.get(tag):
                    close(next(d for d in range(len(stack) - 1, 0, -1) if self.tag[stack[d]] == tag))
                if tag not in INLINE:
                    self.texts.append((stack[-1], " "))
                continue
            if tag == "html":
                continue
            if tag not in INLINE:
                closes = CLOSES.get(tag) or ({"p"} if tag in BLOCK_CLOSES_P else ())
                for depth in range(len(stack) - 1, 0, -1) if any(count.get(x) for x in closes) else ():
                    open_ = self.tag[stack[depth]]
                    if open_ in closes:
                        close(depth)
                        break
                    if open_ in STOPS.get(tag, ()) or open_ not in INLINE and open_ != "p":
                        break
            me = len(self.tag)
            self.tag.append(tag)
            self.words.append(tuple(w.lower() for g in _NAMED.findall(attributes) for w in _WORDS.findall(g[0] or g[1] or g[2])) if attributes else ())
            self.parent.append(stack[-1])
            if tag not in INLINE:
                self.texts.append((me if tag not in VOID else stack[-1], " "))
            if tag not in VOID and tag not in ("script", "style") and not attributes.rstrip().endswith("/"):
                stack.append(me)
                count[tag] = count.get(tag, 0) + 1
                unseen += tag in UNSEEN
        self.texts = [(k, entities.unescape(t)) for k, t in self.texts]


N_BASE = 24
N_FEATURES = N_BASE + len(TAGS) + 1 + 4 + 64


def measures(page: Page) -> np.ndarray:
    """What is measured of each element's subtree, its place and its siblings."""
    n = len(page.tag)
    own, marks, blocks = np.zeros(n), np.zeros(n), np.zeros(n)
    for k, t in page.texts:
        size = len(t) - t.count(" ") if t != " " else 0
        if size:
            own[k] += size
            marks[k] += t.count(".") + t.count(",")
            blocks[k] += 1
    tag = page.tag
    link = np.array([x == "a" for x in tag], float)
    para = np.array([x in ("p", "blockquote", "pre") for x in tag], float)
    field = np.array([x in ("input", "select", "button", "textarea", "form") for x in tag], float)
    item = np.array([x == "li" for x in tag], float)
    head = np.array([len(x) == 2 and x[0] == "h" and x != "hr" for x in tag], float)
    parent = page.parent
    depth, kids, index = np.zeros(n), np.zeros(n), np.zeros(n)
    under_link = link.copy()
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        index[i] = kids[p]
        kids[p] += 1
        if under_link[p]:
            under_link[i] = 1
    # sums over subtrees, which are runs of elements in page order
    s = np.stack([own, own * under_link, marks, np.ones(n), link, para, field, item, head, own * np.array([t in ("p", "pre", "blockquote") for t in tag], float), blocks])
    before = np.cumsum(own) - own  # own text of the elements that open before it
    size = [1] * n
    for i in range(n - 1, 0, -1):
        size[parent[i]] += size[i]
    sums = np.concatenate([np.zeros((len(s), 1)), np.cumsum(s, axis=1)], axis=1)
    s = sums[:, np.arange(n) + np.array(size)] - sums[:, :-1]
    total = max(1.0, s[0, 0])
    text, linked, mark, count, links, paras, fields, items, heads, in_p, blocks_ = s
    up = np.maximum(0, np.array(parent))
    sib = np.maximum(1, kids[up])
    return np.stack(
        [np.log1p(text), text / total, linked / np.maximum(1, text), mark / np.maximum(1, text) * 20, np.log1p(text / count), np.log1p(count), np.log1p(links), np.log1p(paras), np.log1p(fields), np.log1p(items),
         heads, in_p / np.maximum(1, text), np.log1p(text / np.maximum(1, blocks_)), depth, np.log1p(sib), index / sib, text / np.maximum(1, text[up]), before / total, np.log1p(own), own / np.maximum(1, text),
         np.log1p(kids), paras / np.maximum(1, count), np.full(n, np.log1p(total)), (np.array(parent) == 0)], axis=1, dtype=np.float32, casting="unsafe")


def features(page: Page, base: np.ndarray | None = None, first: int = 0, last: int | None = None) -> np.ndarray:
    """A row for each element from first to last: its measures, its tag, its attribute words."""
    base = measures(page) if base is None else base
    last = len(page.tag) if last is None else last
    x = np.zeros((last - first, N_FEATURES), np.float32)
    x[:, :N_BASE] = base[first:last]
    for i, (tag, words) in enumerate(zip(page.tag[first:last], page.words[first:last], strict=True)):
        x[i, N_BASE + _TAG.get(tag, len(TAGS))] = 1
        if words:
            c = N_BASE + len(TAGS) + 1
            for w in words:
                x[i, c + (w in _GOOD)] += w in _GOOD or w not in _BAD
                x[i, c + 2] += w in _BAD
                x[i, c + 4 + hash_word(w) % 64] = 1
            x[i, c + 3] = 1
    return x


_TAG = {t: i for i, t in enumerate(TAGS)}
_GOOD, _BAD = frozenset(GOOD_WORDS), frozenset(BAD_WORDS)


@functools.lru_cache(10_000)
def hash_word(w: str) -> int:
    import zlib

    return zlib.crc32(w.encode())


class Trees:
    """Gradient-boosted trees for three classes, with binned features and depth-wise splits."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)
        used = [j for j, e in enumerate(self.edges) if binned[:, j].max() > 0]
        margin, self.trees = np.zeros((len(x), 3)), []
        for _ in range(ROUNDS):
            p = softmax(margin)
            for k in range(3):
                g, h = (y == k) - p[:, k], np.maximum(p[:, k] * (1 - p[:, k]), 1e-6)
                tree, leaf = self._grow(binned, used, g, h)
                margin[:, k] += RATE * tree[2][leaf]
                self.trees.append((k, *tree))
        return self

    def _grow(self, b, used, g, h):
        """A full tree of DEPTH levels: feature and bin of each inner node, value of each leaf."""
        inner = 2**DEPTH - 1
        feature, cut, node = np.zeros(inner, int), np.full(inner, BINS + 1), np.zeros(len(b), int)
        for level in range(DEPTH):
            base, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            local = node - base
            hists = []
            for j in used:
                at = local * (BINS + 1) + b[:, j]
                hists.append((np.bincount(at, g, width * (BINS + 1)).reshape(width, -1), np.bincount(at, h, width * (BINS + 1)).reshape(width, -1)))
            for j, (hg, hh) in zip(used, hists, strict=True):
                lg, lh = hg.cumsum(1)[:, :-1], hh.cumsum(1)[:, :-1]
                tg, th = hg.sum(1)[:, None], hh.sum(1)[:, None]
                gain = lg**2 / (lh + 1) + (tg - lg) ** 2 / (th - lh + 1) - tg**2 / (th + 1)
                gain[(lh < 2) | (th - lh < 2)] = 0
                top = gain.argmax(1)
                value = gain[np.arange(width), top]
                better = value > best
                best[better] = value[better]
                feature[base : base + width][better] = j
                cut[base : base + width][better] = top[better]
            node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
        leaf = node - inner
        value = np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        threshold = np.array([self.edges[f][c] if c < len(self.edges[f]) else np.inf for f, c in zip(feature, cut, strict=True)])
        return (feature, threshold, value), leaf

    def chances(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros((len(x), 3))
        rows = np.arange(len(x))
        for k, feature, threshold, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            margin[:, k] += RATE * value[node - (2**DEPTH - 1)]
        return softmax(margin)


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


_MAY = {FRAME: (FRAME, CONTENT, CHROME), CONTENT: (CONTENT, CHROME), CHROME: (CHROME,)}


def decode(parent: list[int], chance: np.ndarray, change: float | None = None) -> np.ndarray:
    """The likeliest roles of a tree under the rule of what may hold what.

    A tree in which no content pays its price is decoded again without the price.
    """
    if change is None:
        out = decode(parent, chance, CHANGE)
        return out if (out == CONTENT).any() else decode(parent, chance, 0.0)
    n = len(parent)
    score = np.log(np.maximum(chance, 1e-6)).tolist()
    pick = [[0] * n for _ in range(3)]
    for i in range(n - 1, 0, -1):
        mine, up = score[i], score[parent[i]]
        for role in range(3):
            best = max(_MAY[role], key=lambda r: mine[r] - change * (r != role))
            pick[role][i] = best
            up[role] += mine[best] - change * (best != role)
    out = np.zeros(n, int)
    out[0] = max(range(3), key=score[0].__getitem__)
    for i in range(1, n):
        out[i] = pick[out[parent[i]]][i]
    return out


def text_of(page: Page, role: np.ndarray) -> str:
    return " ".join("".join(t if t == " " or role[k] == CONTENT else " " for k, t in page.texts).split())


def extract_many(htmls: list[str | None], trees: Trees, elements: int = ELEMENTS) -> list[str]:
    """The texts of pages, whose elements are judged some thousands at a time, across pages or within one."""
    out, held, n = [], [], 0

    def flush() -> None:
        nonlocal n
        if held:
            chance, at = trees.chances(np.concatenate([x for _, x in held])), 0
            for p, x in held:
                out.append(text_of(p, decode(p.parent, chance[at : at + len(x)])))
                at += len(x)
        held.clear()
        n = 0

    for h in htmls:
        page = Page(h or "")
        size = len(page.tag)
        if n + size > elements:
            flush()
        if size <= elements:
            held.append((page, features(page)))
            n += size
        else:
            base = measures(page)
            chance = np.concatenate([trees.chances(features(page, base, i, min(i + elements, size))) for i in range(0, size, elements)])
            out.append(text_of(page, decode(page.parent, chance)))
    flush()
    return out


# --- the layouts that the trees learn from ------------------------------------------------------


class Maker:
    """Random pages with known roles; what is made carries its role in an attribute that is taken off."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def pick(self, *xs):
        return xs[self.r.integers(len(xs))]

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def words(self, low: int, high: int) -> str:
        n = int(self.r.integers(low, high + 1))
        w = ["".join(self.r.choice(list("abcdefghijklmnoprstuvwz"), int(self.r.integers(2, 9)))) for _ in range(n)]
        for i in range(0, n, 9):
            w[min(n - 1, i + 8)] += self.pick(".", ",", ".")
        return " ".join(w).capitalize()

    def el(self, tag: str, inner: str, role: str = "", names: tuple = ()) -> str:
        name = ""
        if names and self.chance(0.85):
            name = f' {self.pick("class", "class", "id")}="{self.pick(*names)}{self.pick("", "", "-inner", " box", "_1", "-wrap")}"'
        elif self.chance(0.15):
            name = f' class="{self.words(1, 1).lower().strip(".,")}"'
        return f"<{tag}{name}{f' @{role}' if role else ''}>{inner}</{tag}>"

    def links(self, n: int, tag: str = "li") -> str:
        return "".join(f"<{tag}><a href='/x'>{self.words(1, 4)}</a></{tag}>" for _ in range(n))

    def chrome(self, where: str) -> str:
        r = self.r
        made = {
            "nav": lambda: self.el(self.pick("nav", "nav", "div", "ul"), self.pick("<ul>%s</ul>", "%s") % self.links(int(r.integers(3, 12))), "x", ("nav", "menu", "navbar", "navigation", "breadcrumb", "toolbar", "skip-links")),
            "head": lambda: self.el(self.pick("header", "div"), f"<div>{self.words(1, 5)}</div>" + self.links(int(r.integers(0, 5)), "span"), "x", ("header", "masthead", "site-header", "banner", "top")),
            "foot": lambda: self.el(self.pick("footer", "footer", "div"), self.pick("&copy; ", "", "Copyright ") + self.words(2, 30) + self.pick("", "<ul>%s</ul>" % self.links(int(r.integers(2, 8)))), "x", ("footer", "site-footer", "copyright", "legal", "foot", "disclaimer")),
            "side": lambda: self.el(self.pick("aside", "div"), f"<h3>{self.words(1, 4)}</h3>" + self.pick("<ul>%s</ul>" % self.links(int(r.integers(2, 10))), f"<p>{self.words(4, 60)}</p>", self.links(4, "div")), "x", ("sidebar", "widget", "related", "recommended", "popular", "trending", "more", "rail", "side")),
            "ad": lambda: self.el(self.pick("div", "div", "section", "aside", "p"), self.pick("%s", "<p>%s</p>", "<a href='/y'>%s</a>") % self.words(2, 40), "x", ("ad", "ads", "advert", "advertisement", "promo", "sponsored", "banner", "sponsor")),
            "notice": lambda: self.el(self.pick("div", "section", "p"), self.pick("%s", "<p>%s</p>", "<p>%s</p><button>ok</button>") % self.words(5, 60), "x", ("cookie", "cookies", "consent", "notice", "gdpr", "alert", "popup", "modal", "overlay", "warning")),
            "form": lambda: self.el(self.pick("form", "form", "div"), f"<label>{self.words(1, 5)}</label><input type='text'>{self.pick('', '<button>go</button>')}<p>{self.words(2, 25)}</p>", "x", ("search", "login", "subscribe", "newsletter", "signup", "form")),
            "comments": lambda: self.el(self.pick("section", "div", "ol", "aside"), f"<h3>{self.words(1, 3)}</h3>" + "".join(self.el(self.pick("div", "li", "article"), f"<b>{self.words(1, 2)}</b><p>{self.words(4, 70)}</p>", "", ("comment", "reply", "comment-body")) for _ in range(int(r.integers(1, 6)))), "x", ("comments", "comment-list", "discussion", "replies", "responses")),
            "share": lambda: self.el(self.pick("div", "ul"), self.links(int(r.integers(2, 6)), "span"), "x", ("share", "social", "follow", "tags", "sharing")),
        }
        kinds = {"top": ("nav", "head", "notice", "ad", "form"), "in": ("ad", "side", "share", "form", "notice"), "end": ("foot", "side", "comments", "nav", "ad", "share", "form", "notice"), "after": ("comments", "share", "side", "form")}[where]
        return made[self.pick(*kinds)]()

    def content(self) -> str:
        r, out = self.r, []
        if self.chance(0.85):
            h = f"<h1>{self.words(2, 12)}</h1>"
            out.append(self.pick(h, h, f"<header>{h}<p>{self.words(3, 20)}</p></header>"))
        for _ in range(int(r.integers(1, self.pick(3, 8, 25)))):
            k = r.random()
            if k < 0.72:
                text = self.words(1, self.pick(8, 40, 160))
                if self.chance(0.15):
                    text += f" <a href='/z'>{self.words(1, 4)}</a> {self.words(2, 12)}"
                out.append(self.pick(f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}</p>", f"<p><b>{text}<br>", f"<p>{text}", f"<div>{text}</div>", f"{text}<br><br>"))
            elif k < 0.78:
                out.append(f"<h2>{self.words(1, 8)}</h2>")
            elif k < 0.83:
                out.append("<ul>%s</ul>" % "".join(f"<li>{self.words(2, 20)}</li>" for _ in range(int(r.integers(2, 7)))))
            elif k < 0.87:
                out.append(f"<blockquote>{self.words(5, 50)}</blockquote>")
            elif k < 0.90:
                out.append("<table>%s</table>" % "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(int(r.integers(2, 6)))))
            elif k < 0.93:
                out.append(f"<pre>{self.words(4, 30)}</pre>")
            elif k < 0.95:
                out.append(f"<figure><img src='a'><figcaption>{self.words(2, 15)}</figcaption></figure>")
            else:
                out.append(self.chrome("in"))
        if self.chance(0.2):
            out.append(self.chrome("after"))
        return "".join(out)

    def page(self) -> str:
        names = ("content", "article", "post", "entry", "story", "main", "article-body", "post-content", "entry-content", "page-text", "blog-post", "news-detail")
        main = self.el(self.pick("article", "article", "div", "main", "section", "div"), self.content(), "c", names)
        if self.chance(0.3):
            main = self.el(self.pick("div", "section"), main, "c", names)
        around = [self.chrome("in") for _ in range(int(self.r.integers(0, 2)))]
        inner = self.pick("".join([main, *around]), "".join([*around, main]))
        if self.chance(0.6):
            inner = self.el(self.pick("div", "main", "section"), inner, "f", ("wrapper", "container", "layout", "page", "main", "content"))
        top = "".join(self.chrome("top") for _ in range(int(self.r.integers(0, 4))))
        end = "".join(self.chrome("end") for _ in range(int(self.r.integers(0, 4))))
        body = top + inner + end
        if self.chance(0.3):
            body = self.el("div", body, "f", ("wrapper", "container", "layout", "page"))
        return f"<html><head><title>{self.words(2, 9)}</title></head><body>{body}</body></html>"


def labelled(seed: int) -> tuple[Page, np.ndarray]:
    """A made page and the role of each element; below a marked element its role holds."""
    marked = Maker(seed).page()
    kinds = [m[1] for m in re.finditer(r"<[a-zA-Z][^>]*?(?: @([xcf]))?>", marked)]
    page = Page(re.sub(r" @[xcf](?=>)", "", marked))
    role = np.full(len(page.tag), FRAME)
    # elements come in page order in both; the first <html> is the root
    for i in range(1, len(page.tag)):
        own = {"x": CHROME, "c": CONTENT, "f": FRAME}.get(kinds[i] or "")
        above = role[page.parent[i]]
        role[i] = CHROME if above == CHROME else above if own is None else own
        if page.tag[i] in ("head", "title"):
            role[i] = CHROME
    return page, role


@functools.lru_cache(1)
def fitted(pages: int = TRAIN_PAGES) -> Trees:
    made = [labelled(s) for s in range(pages)]
    return Trees().fit(np.concatenate([features(p) for p, _ in made]), np.concatenate([r for _, r in made]))


def extract(pages: DataFrame, trees: Trees | None = None, html_col: str = "html", out: str = "_text") -> DataFrame:
    """pages with ``out``, the main text of each whole page; all rows and columns stay."""
    trees = trees or fitted()

    def run(htmls: pd.Series) -> pd.Series:
        return pd.Series(extract_many([h if isinstance(h, str) else None for h in htmls], trees), dtype=object)

    return pages.withColumn(out, F.pandas_udf(run, "string")(F.col(html_col)))
