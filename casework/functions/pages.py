"""Predicates on fetched documents and their sources: blocked, boilerplate, navigation, status, wrapper, signal, credibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casework.functions.text import strip_markers
from casework.operators.ranking import case_of

# Phrases of walls, menus and legal lines; those that spoil a text alone; those of menus.
BOILERPLATE = [
    "sign up for our newsletter", "subscribe to our newsletter", "click here to subscribe", "sign in to continue", "sign in to read", "sign in to access",
    "log in to continue", "create a free account", "buy a subscription", "subscribe to continue", "subscribe to read", "subscribe to access",
    "become a member", "unlock full access", "already a subscriber", "subscription required",
    "follow us on", "share this article", "download the app", "get the app", "click here", "read more", "related articles", "more stories",
    "most popular", "trending now", "you may also like", "recommended for you", "also read",
    "terms of service", "privacy policy", "all rights reserved", "javascript is required", "enable javascript", "please enable",
    "cookie policy", "we use cookies", "your subscription", "newsletter signup", "advertisement", "sponsored content",
]
HARD = [
    "sign in to continue", "sign in to read", "subscribe to continue", "subscribe to read", "subscription required", "unlock full access",
    "create a free account to read", "before you continue to google", "enable javascript to continue", "javascript is required to view",
]
MENU = [
    "sign in", "log in", "subscribe", "newsletter", "advertisement", "related articles", "click here", "read more", "most popular",
    "trending", "you may also like", "follow us", "download the app", "share on", "copy link", "copied!", "email this",
]
#: Spaces of any width; no tabs or line ends.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
WRAPPER_URLS = ["news.google.com", "google.com/search", "accounts.google.com", "feedproxy.google.com"]
COOKIE_WALLS = [r"(?i)accept.*cookies.*and.*continue", r"(?i)before you continue to google", r"(?i)we use cookies to"]
JUNK_PHRASES = ["google news", "sign in to continue", "subscribe to continue", "enable javascript"]
# Words that make a document's signal, counted in its first 5,000 characters.
FINANCIAL = r"\$|USD|budget|funding|grant|contract|appropriation|invest|award|payment|spending|allocated"
INVESTIGATIVE = r"fraud|corruption|kickback|bribery|embezzlement|laundering|whistleblower|subpoena|audit|misconduct|indictment|conviction|probe|oversight|accountability|procurement|no-bid|sole.source|shell company"
CONTEXT = r"contract|housing|homeless|shelter|program|authority|department|procurement|grant|budget|allocation|oversight|compliance|violation|lawsuit|investigation|permit|rezoning|development"
# Hosts by tier, the first that holds.
LEGAL = ["pacer.gov", "courtlistener.com", "documentcloud.org", "recap.law"]
QUALITY_NEWS = [
    "latimes.com", "nytimes.com", "washingtonpost.com", "propublica.org", "apnews.com", "reuters.com", "nbcnews.com", "cbsnews.com", "abcnews.go.com", "theatlantic.com", "politico.com", "theintercept.com",
    "calmatters.org", "laist.com", "kpcc.org", "kcrw.com", "voiceofsandiego.org", "sfchronicle.com", "sacbee.com", "theguardian.com", "bloomberg.com", "wsj.com",
]
LOCAL_NEWS = [
    "patch.com", "dailynews.com", "pasadenastarnews.com", "sgvtribune.com", "presstelegram.com", "ocregister.com", "dailybulletin.com", "inland", "signal", "tribune", "herald", "gazette", "observer",
    "abc7.com", "nbcla.com", "kcal9.com", "fox11.com", "ktla.com",
]
PR_HOSTS = ["prnewswire.com", "businesswire.com", "globenewswire.com", "prweb.com", "accesswire.com", "einpresswire.com"]
PR_PHRASES = ["press release", "for immediate release", "media contact"]
LOW_SOURCES = ["reddit.com", "twitter.com", "x.com", "facebook.com", "instagram.com", "tmz.com", "buzzfeed.com", "dailymail.co.uk", "nypost.com", "pagesix.com", "tmzone.com", "yelp.com"]


def lowered(c: Column) -> Column:
    """A text in lower case, each character one, as DuckDB and RE2 have it: F.lower would put a dot of its own behind the i of U+0130 and part a phrase."""
    return F.lower(F.replace(c, F.lit("\u0130"), F.lit("i")))


def has_any(c: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))


def count_of(c: Column, words: list[str]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(c, w)))


def _has(c: Column, *marks: str) -> Column:
    return has_any(F.coalesce(c, F.lit("")), list(marks))


def is_blocked_for_analysis(raw: Column) -> Column:
    """No text of ten characters, or a marker of a failed fetch."""
    bad = _has(raw, "[WRAPPER_BLOCKED]", "[EXTRACTION_FAILED]", "[FETCH_FAILED]", "[INVALID_CONTENT]")
    return bad | (F.length(F.trim(F.coalesce(raw, F.lit("")))) < 10) | (F.length(strip_markers(F.coalesce(raw, F.lit("")))) < 10)


def is_blocked_for_backfill(raw: Column) -> Column:
    """A marker of a failed fetch or status, or no text of a hundred characters."""
    bad = _has(raw, "[WRAPPER_BLOCKED]", "[FETCH_FAILED]") | (raw.rlike(r"\[(?:[A-Z]+-)?DIAG:") & _has(raw, "status=failed", "status=wrapper"))
    return F.coalesce(bad, F.lit(False)) | (F.length(F.trim(F.coalesce(raw, F.lit("")))) < 100) | (F.length(strip_markers(F.coalesce(raw, F.lit("")))) < 100)


def is_purged(raw: Column, kind: str = "all-failed") -> Column:
    if kind in ("failed", "wrapper"):
        return _has(raw, "[FETCH_FAILED]" if kind == "failed" else "[WRAPPER_BLOCKED]")
    return _has(raw, "[FETCH_FAILED]", "[WRAPPER_BLOCKED]") | (_has(raw, "status=failed") & ~_has(raw, "status=ok", "status=partial"))


def is_usable(raw: Column) -> Column:
    """For a case's overview: no failed status, wrapper or noise; without a marker, more than a hundred characters."""
    marked = raw.rlike(r"\[(?:[A-Z]+-)?DIAG:")
    return F.coalesce(F.when(marked, ~_has(raw, "status=failed", "status=wrapper", "priority=NOISE")).otherwise(F.length(raw) > 100), F.lit(False))


def trimmed_all(parts: Column) -> Column:
    """Texts without spaces of any width at their ends. Given bare, F.trim would take a text's place in its list as the characters to trim."""
    return F.transform(parts, lambda x: F.trim(x, F.lit(SPACES)))


def paragraphs(c: Column) -> Column:
    """How many real paragraphs: eighty characters, a sentence end, no stock phrase."""
    return F.size(F.filter(trimmed_all(F.split(c, r"\n\n+")), lambda p: (F.length(p) >= 80) & p.rlike("[.!?]") & ~has_any(lowered(p), BOILERPLATE)))


def is_boilerplate(c: Column) -> Column:
    low = lowered(c)
    return has_any(low, HARD) | (count_of(low, BOILERPLATE) >= 2)


def is_menu(c: Column) -> Column:
    """Whether a text is mostly menus: many menu phrases, mostly short lines, or hardly a sentence."""
    n, found = F.length(c), count_of(lowered(c), MENU)
    lines = F.filter(trimmed_all(F.split(c, "\n")), lambda x: x != "")
    short = F.size(F.filter(lines, lambda x: F.length(x) < 40))
    said = F.size(F.filter(trimmed_all(F.split(c, "[.!?]+")), lambda x: F.length(x) > 15))
    return ((found >= 4) & (n < 1500)) | (found * 500 > n * 3) | ((F.size(lines) > 5) & (short > 0.6 * F.size(lines))) | ((n > 400) & (said < 2))


def extraction_status(c: Column, density: Column) -> Column:
    """invalid, valid or partial, by length, sentences, stock phrases, menus, density and paragraphs."""
    n = F.length(c)
    bad = (n < 500) | ~c.rlike(r"[A-Z][^.!?]{40,}[.!?]") | is_boilerplate(c) | is_menu(c)
    return case_of("invalid", (bad, "invalid"), ((density >= 45) & (paragraphs(c) >= 2) & (n >= 800), "valid"), (density >= 20, "partial"))


def is_wrapper(html: Column, url: Column, text: Column) -> Column:
    """Whether a page only leads to another, asks for cookies, or has no text of its own."""
    head, low = F.lower(F.substring(html, 1, 3000)), F.lower(text)
    own = F.contains(head, F.lit("<!doctype html>google")) | F.contains(head, F.lit("<title>google news</title>")) | (F.contains(head, F.lit("news.google.com/articles")) & (F.length(html) < 10000))
    wall = (F.length(html) < 8000) & (html.rlike(COOKIE_WALLS[0]) | html.rlike(COOKIE_WALLS[1]) | html.rlike(COOKIE_WALLS[2]))
    return has_any(F.lower(url), WRAPPER_URLS) | own | wall | (F.length(F.trim(text)) < 120) | (has_any(low, JUNK_PHRASES) & (F.length(text) < 300))


def signal(raw: Column, n_entities: Column | None = None) -> Column:
    """HIGH, MEDIUM or LOW by words of money and inquiry, length and entities."""
    text = F.substring(raw, 1, 5000)
    count = lambda p: F.regexp_count(text, F.lit(f"(?i){p}"))
    n = F.coalesce(n_entities, F.lit(0)) if n_entities is not None else F.lit(0)
    score = F.least(F.lit(3), count(FINANCIAL)) + F.least(F.lit(3), 2 * count(INVESTIGATIVE)) + F.least(F.lit(2), count(CONTEXT)) + F.when(F.length(text) > 3000, 1).otherwise(0) + case_of(0, (n >= 5, 2), (n >= 2, 1))
    return case_of("LOW", (score >= 7, "HIGH"), (score >= 3, "MEDIUM"))


def credibility(domain: Column, raw: Column, from_web: Column) -> Column:
    """The tier of a source by its host, or by a press release's first words; null for a file without a host."""
    d = F.lower(F.coalesce(domain, F.lit("")))
    gov = d.endswith(".gov") | has_any(d, [".ca.gov", ".state.", "congress.", "senate.gov", "house.gov"])
    release = has_any(F.lower(F.substring(F.coalesce(raw, F.lit("")), 1, 400)), PR_PHRASES)
    tiers = case_of("BLOG", (gov, "GOV"), (has_any(d, LEGAL), "LEGAL"), (has_any(d, QUALITY_NEWS), "QUALITY-NEWS"), (has_any(d, LOCAL_NEWS), "LOCAL-NEWS"), (has_any(d, PR_HOSTS) | release, "PR-WIRE"), (has_any(d, LOW_SOURCES), "LOW-SRC"))
    return F.when((d != "") | from_web, tiers)


def is_seed(c: Column) -> Column:
    """Whether a target can start a case: 3 to 300 characters, two letters together, not one word of under three letters."""
    t = F.trim(c)
    words = F.split(F.trim(F.regexp_replace(t, r"[^a-zA-Z\s]", "")), r"\s+")
    return F.coalesce((F.length(t) >= 3) & (F.length(t) <= 300) & t.rlike("[a-zA-Z]{2,}") & ((F.size(words) > 1) | F.exists(words, lambda w: F.length(w) >= 3)), F.lit(False))
