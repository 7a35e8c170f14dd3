import itertools
import random
from html.parser import HTMLParser

import pytest

from tests.llm.conftest import SMALL, needs_data
from varak.llm import html_text as H


def test_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 8)
        odds = [rng.choice([-1, 1]) * rng.random() * 2 for _ in range(n)]
        edges = [{} for _ in range(n)]
        for i, j in itertools.combinations(range(n), 2):
            if rng.random() < 0.5:
                edges[i][j] = edges[j][i] = rng.random()

        def cost(keep, odds=odds, edges=edges):
            wrong = sum(abs(o) for o, k in zip(odds, keep) if (o > 0) != bool(k))
            return wrong + sum(w for i, e in enumerate(edges) for j, w in e.items() if i < j and keep[i] != keep[j])

        best = min(map(cost, itertools.product((0, 1), repeat=n)))
        assert cost(H.label(odds, edges)) == pytest.approx(best)
        assert cost(H._max_flow(odds, edges)) == pytest.approx(best)


def made_page(rng):
    """A page of up to 11 blocks, many of them hard to tell."""
    long = lambda: " ".join(rng.choice(["river", "stone", "light", "house", "winter"]) for _ in range(rng.randint(3, 40))) + rng.choice([".", ""])
    link = lambda: f"<a href=/x>{rng.choice(['more', 'go to the next of these pages', 'top'])}</a>"
    parts = []
    for _ in range(rng.randint(1, 5)):
        kind, name = rng.choice(["div", "section", "article", "aside", "ul"]), rng.choice(["", "", " class='related links'", " class='content'", " id='legal-notes'", " class='ad'"])
        inner = [f"<{'li' if kind == 'ul' else 'p'}>{rng.choice([long, link, lambda: 'ok'])()}" for _ in range(rng.randint(1, 3))]
        parts.append(f"<{kind}{name}>{''.join(inner)}</{kind}>")
    return "<html><body>" + "".join(parts[:4]) + "</body></html>"


def test_the_minimum_cut_decides_the_text(monkeypatch):
    rng, calls, flow = random.Random(11), [0], H._max_flow
    monkeypatch.setattr(H, "_max_flow", lambda *a: calls.__setitem__(0, calls[0] + 1) or flow(*a))
    blocks = undecided = changed = 0
    for _ in range(250):
        page = made_page(rng)
        found = H.blocks_of(page)
        odds, edges = [b.odds for b in found], H.graph_of(found)

        def cost(keep, odds=odds, edges=edges):
            wrong = sum(abs(o) for o, k in zip(odds, keep) if (o > 0) != bool(k))
            return wrong + sum(w for i, e in enumerate(edges) for j, w in e.items() if i < j and keep[i] != keep[j])

        best = min(itertools.product((0, 1), repeat=len(odds)), key=cost)
        text = [b.text for b, k in zip(found, best) if k]
        assert cost(H.label(odds, edges)) == pytest.approx(cost(best))
        if sum(cost(k) < cost(best) + 1e-6 for k in itertools.product((0, 1), repeat=len(odds))) == 1:
            assert H.extract(page) == "\n\n".join(text)
        blocks += len(odds)
        undecided += sum(abs(o) <= sum(e.values()) for o, e in zip(odds, edges) if e)
        changed += sum((o > 0) != bool(k) for o, k in zip(odds, best))
    assert calls[0] > 50 and undecided > 0.1 * blocks and changed > 0.01 * blocks


def test_neighbours_settle_what_a_block_alone_does_not():
    text = "A sentence that is long enough to look like content does here."
    page = f"<div><p>{text}</p><p><a href=x>the linked line</a></p><p>{text}</p></div>"
    assert [b.odds > 0 for b in H.blocks_of(page)] == [True, False, True] and len(H.extract(page).split("\n\n")) == 3
    page = "<div><p><a href=x>one</a></p><p><a href=x>two</a></p><p>So it is.</p><p><a href=x>three</a></p><p><a href=x>four</a></p></div>"
    assert [b.odds > 0 for b in H.blocks_of(page)] == [False, False, True, False, False] and H.extract(page) == ""


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article class="post tags-news"><p>The news of today.</p><p>More of it.</p></article>', "The news of today.\n\nMore of it."),
        ('<article><p data-id="ad-12">Some text here.</p></article>', "Some text here."),
        ('<article><p>One.</p><div class="legal-history"><p>The history of law in short.</p></div></article>', "One.\n\nThe history of law in short."),
        ("<article><p>Let <math><mi>x</mi><annotation>x tex</annotation></math> be.</p></article>", "Let x be."),
        ('<body class="has-sidebar comments-open"><article><p>The text.</p></article></body>', "The text."),
        ('<article class="post comments-open"><p>The text of the post.</p></article>', "The text of the post."),
        ("<head><title>No</title><meta name=x><p>Head left open.</p>", "Head left open."),
        ('<article><p>Text.</p><section id="comments"><p>I liked this article very much, thank you.</p></section></article>', "Text."),
        ('<article><p>Text.</p><div class="ad">Buy this very nice thing today.</div><p>Text.</p></article>', "Text.\n\nText."),
        ("<article><p>Text.</p><aside>You may like to read these things as well.</aside><form>Your name, please.</form></article>", "Text."),
        ("<article><header><h1>Title</h1></header><p>Text.</p><footer>Filed under things of today.</footer></article>", "Title\n\nText."),
    ],
)
def test_names_and_tags_are_hints_only(page, text):
    assert H.extract(page) == text


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href="/">Site</a> <h2>The best site about a great many things.</h2></header><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div class="cookie-banner">We use cookies to make this site better for you and for everyone.</div>
<div id="main-content"><h1>A  title</h1><p>First long&nbsp;sentence of the text, with a <a href=x>link</a> &amp; more &lt;signs&gt;.
<p>Short.<br>Line<ul><li>item one</li><li>item two</ul><table><tr><td>a</td><td>b</td></tr></table></div>
<div class="ad">Buy this very nice thing today, it is really cheap and good.</div><form>Your name <input name=n> please.</form>
<aside>Related things that you may like to read as well.</aside><section id="comments"><p>I liked this article very much, thank you for sharing it.</p></section>
<footer>All about us and our terms of use.</footer></body></html>"""


def test_main_text_of_a_page():
    assert H.extract(PAGE).split("\n\n") == ["A title", "First long sentence of the text, with a link & more <signs>.", "Short. Line", "item one", "item two", "a b"]


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("just some words here", "just some words here"),
        ("<article><p>a 3 < 4 &am", "a 3 < 4 &am"),
        ("<article><p>open <b>bold<p>next</article>", "open bold\n\nnext"),
        ("<article><p>x<!-- no > --> y</p></article>", "x y"),
        ("<article><p title='a>b'>z</p></article>", "z"),
        ("<nav>menu", ""),
        ("<article><p>cut off <a hre", "cut off"),
        ("<script>never closed", ""),
        ('<article><p style="display:none">hidden</p><p>Seen.</p></article>', "Seen."),
    ],
)
def test_edge_pages(page, text):
    assert H.extract(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>One.</p><svg class='i'/><p>Two is long.</p></article>", "One.\n\nTwo is long."),
        ("<article><p>One <math/>two <svg a='/>' />three.</p><p>Four.</p></article>", "One two three.\n\nFour."),
        ("<article><svg-icon></svg-icon><p>One.</p><p>Two.</p></article>", "One.\n\nTwo."),
        ("<title-bar><select-box/></title-bar><article><p>One.</p></article>", "One."),
        ("<article><p>One.</p><svg a='/>'>no</svg><SVG>no</SVG><svg\n>no</svg><p>Two.</p></article>", "One.\n\nTwo."),
    ],
)
def test_raw_elements_end_where_they_should(page, text):
    assert H.extract(page) == text


def test_very_long_and_deep_pages():
    body = "".join(f"<p>Paragraph number {i} of the long text.</p><div class=ad>Buy {i}</div>" for i in range(20_000))
    assert len(H.extract(f"<article>{body}</article>").split("\n\n")) == 20_000
    assert H.extract("<div>" * 30_000 + "Some text in the deep of the page.") == "Some text in the deep of the page."


def test_hard_cut_without_settled_blocks():
    n = 400
    odds = [(-1) ** i * 0.9 for i in range(n)]
    edges = [{j: 1.0 for j in (i - 1, i + 1) if 0 <= j < n} for i in range(n)]
    assert len(set(H.label(odds, edges))) == 1


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, None, None, "y"), (None, "u", "<p>One é\U0001f600.</p>", "z")], "page_id long, url string, html string, text string")
    got = H.main_text(df).collect()
    assert len(got) == 3 and all(r.n_chars == len(r.text) for r in got)
    assert H.main_text(df.limit(0)).count() == 0


class Article(HTMLParser):
    """The blocks of the article element, by the parser of the standard library."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts, self.now = 0, [], ""
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        if self.inside and self.now.split():
            self.parts.append(" ".join(self.now.split()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.now += " "
        elif tag in H.BLOCK_TAGS:
            self.end()
            self.inside += tag == "article"

    def handle_endtag(self, tag):
        if tag in H.BLOCK_TAGS:
            self.end()
            self.inside -= tag == "article" and self.inside > 0

    def handle_data(self, data):
        self.now += data


@needs_data
def test_query_equals_the_articles(spark):
    pages = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/pages.parquet").collect()
    got = {r.page_id: r for r in H.query(spark, SMALL.replace("0.001", "0.01")).collect()}
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id].text == "\n\n".join(Article(p.html or "").parts) and got[p.page_id].url == p.url
