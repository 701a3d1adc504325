import random
import re
import time

import pytest

from casework.functions.documents import density
from casework.functions.pages import BOILERPLATE, MENU
from casework.operators import articles

SAID = ["The council of the county approved the budget of the shelter program for the next year.", "An audit found $4,500 missing in 2021 and 12% more!", "Was it 3 million dollars or not?", "Short.", "no stop here", "Read more about it here.", "Subscribe to read the newsletter", "x", "It was a long and winding hearing that went on for the whole day, as many had feared it would."]
NAMES = ["", " class='article-body'", ' class="post-content big"', " id=content", " id='main'", " role=main", " class=sidebar", ' data-component="text"', " itemprop=articleBody", " class=ad"]


def made(seed):
    rng = random.Random(seed)

    def inner(depth):
        out = []
        for _ in range(rng.randint(1, 5)):
            kind = rng.random()
            if kind < 0.55 or depth > 5:
                text = rng.choice([" ", "\n", "  "]).join(rng.choices(SAID, k=rng.randint(1, 5)))
                out.append(rng.choice([f"<p>{text}</p>", f"<p>{text}", f"<b>{text}</b>", text, f"<p>a <i>{text}</i>&amp; more</p>"]))
            else:
                tag = rng.choice(["div", "div", "section", "article", "main", "nav", "li", "p"])
                out.append(f"<{tag}{rng.choice(NAMES)}>{inner(depth + 1)}" + (f"</{tag}>" if rng.random() < 0.9 else ""))
        return "".join(out)

    return f"<html><head><title>t</title></head><body>{inner(0)}</body></html>"


def plain(html, every):
    """The same choice with every candidate written out and measured by itself."""
    page = articles.Page(html)
    text = lambda e: page.text[e[2] : e[3]]
    stock = lambda t: any(b in t.lower() for b in BOILERPLATE)
    paras = [e for e in page.elements if e[0] == "p"]
    inside = lambda e: [p for p in paras if e[2] <= p[2] < e[3]]
    clean = lambda ps: [text(p) for p in ps if len(text(p)) > 50 and not stock(text(p))]
    best, out, label = 0, "", "none"
    for name in articles.PLACES:
        for e in [e for e in page.elements if name in e[1]][: None if every else 1]:
            t = "\n\n".join(clean(inside(e))) if len(inside(e)) >= 2 else ""
            t = t if len(t) >= 300 else text(e)
            if len(t) > 250 and articles.density_of(t) > best and not (label != "none" and best >= 60 and len(out) >= 1500):
                best, out, label = articles.density_of(t), t, name
    if best < 40:
        long_ = [t for t in clean(paras) if len(t) >= 60 and len(t.split()) >= 8 and re.search("[.!?]", t)]
        if len(long_) >= 2 and articles.density_of("\n\n".join(long_)) > best:
            out, label = "\n\n".join(long_), "p-aggregate"
            best = articles.density_of(out)
    if best < 35 or len(out) < 600:
        for e in page.elements:
            t = text(e)
            if e[0] in ("div", "section", "article") and len(t) >= 300 and sum(w in t.lower() for w in MENU) <= 5:
                own = [x for x in clean(inside(e)) if re.search("[.!?]", x)]
                t = "\n\n".join(own) if len(own) >= 2 else t
                if len(t) > 400 and articles.density_of(t) > best:
                    best, out, label = articles.density_of(t), t, "div-density"
    if len(out) < 200:
        out, label = page.text.strip(), "body"
    return out, label


@pytest.mark.parametrize("every", [True, False])
def test_choice_against_all_candidates_written_out(every):
    labels = set()
    for seed in range(300):
        page = made(seed)
        got = articles.article_of(page, every)
        assert got == plain(page, every), seed
        labels.add(got[1])
    assert len(labels) >= 6


def test_density_of_intervals_equals_the_column(spark):
    texts = [articles.article_of(made(s))[0] for s in range(120)] + ["", "x" * 60, "One.\n\nTwo. " * 30, "\n".join(["menu item"] * 40), "Read more. Click here. " * 20, ("A long line of words that goes on and on until it is quite long indeed. " * 2 + "\n\n") * 9]
    got = [r.d for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(density(articles.F.col("t")).cast("int").alias("d")).collect()]
    assert got == [articles.density_of(t) for t in texts] and len(set(got)) > 10


def test_any_interval_equals_its_own_text():
    rng = random.Random(1)
    for seed in range(60):
        page = articles.Page(made(seed))
        whole = articles.Text(page.text)
        starts = [m.start() for m in re.finditer(r"(?<![^ ])\S", page.text)]
        ends = [m.end() for m in re.finditer(r"\S(?![^ ])", page.text)]
        for _ in range(30):
            s, e = rng.choice(starts), rng.choice(ends)
            if s < e:
                assert whole.density(s, e) == articles.density_of(page.text[s:e]), (seed, s, e)


def test_pages_of_a_megabyte_take_linear_time():
    pieces = ["<div>x", "<div>", "<a ", "<p>one two", "<p>a</i>", "<!x ", "<b '", "<script>", "<div class='a b' id=c>It went on. ", "</div>", "a < b ", "<a href='x' ", "<div><p>Some words of a story that goes on. 1999", "<p>Read more</p>", "<a " + "x" * 50, "<div>Click here. Sign in.", "<article>word. "]
    for piece in pieces:
        text = piece * ((1 << 20) // len(piece)) + "<p>the end"
        began = time.process_time()
        out = articles.article_of(text)
        took = time.process_time() - began
        assert took < 6 and len(out[0]) <= len(text), (piece, took)
    assert articles.article_of("<a " + "y" * (1 << 20) + ">z")[0] == "z"


def test_every_element_of_a_place_is_tried():
    teaser, story = "<article><p>A teaser of some length, which says little and goes on for a while, so that it counts, more or less. " + "and so on " * 20 + "</article>", "<article>" + "".join(f"<p>{SAID[0]} {SAID[8]} In {y} it was $5 million.</p>" for y in range(2000, 2012)) + "</article>"
    page = f"<html><body>{teaser}{story}</body></html>"
    assert articles.article_of(page)[0].count("million") == 12 and articles.article_of(page)[1] == "article"
    assert "million" not in articles.article_of(f"<html><body>{teaser}</body></html>", every=False)[0]


def test_script_and_style_text_is_unseen():
    page = "İİİ<SCRIPT>if (a < b) '<p>no</p>'</ScRipt ><style>p > a {}</style><!-- <p>no --><p>yes &lt;b&gt; &nbsp;x</p>"
    assert articles.Page(page).text.strip() == "İİİyes <b> x"
