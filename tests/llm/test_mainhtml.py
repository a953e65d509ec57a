import random
import time
from itertools import product

import pytest
from hypothesis import given, settings, strategies as st

from weblode.llm import mainhtml

SHOP = """<!doctype html><html><head><title>T &amp; t</title><style>p{}</style></head><body class="has-sidebar">
<header><div class=logo>Acme</div><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav></header>
<div class="cookie-notice">We use cookies. Accept them all, they are good for you and for everyone else.</div>
<div id="main-content"><h1>A walk  in
the <i>hills</i></h1><p>The path climbs slowly through the old wood and comes out above the lake.<p>From there one sees
far &amp; wide&hellip; <b>really far</b>.<!-- ad --><div class="ad-slot">Buy boots now, they are cheap and they last a lifetime.</div>
<ul><li>Bring water.<li>Bring bread.</ul><script>var x = "<p>no</p>";</script></div>
<section id=comments><h3>Comments</h3><div class=comment><p>What a lovely walk, we went there last summer with the children.</p></div></section>
<aside class="sidebar"><p>Related walks that many of our readers liked a lot this year.</p></aside>
<form action=/s><label>Name</label><input name=n><button>Send</button></form>
<footer>&copy; Acme. All rights reserved.</footer></body></html>"""


def test_shop():
    assert mainhtml.main_blocks(SHOP) == [
        "A walk in the hills", "The path climbs slowly through the old wood and comes out above the lake.", "From there one sees far & wide… really far.", "Bring water.", "Bring bread.",
    ]


def test_layout_classes_say_nothing():
    page = """<div class="wrap with-sidebar"><div class="post-body"><p>The ferry leaves at noon and comes back late in the evening.</p></div>
    <div class="right-sidebar"><p>The weather of the week, day by day, for every island of the bay.</p></div></div>"""
    assert mainhtml.main_blocks(page) == ["The ferry leaves at noon and comes back late in the evening."]


TEXT = ["The ferry leaves at noon and comes back late in the evening, on every day of the week but one.", "Those who miss it sleep at the inn, which has nine rooms and a good kitchen, or walk back over the dam."]
ARTICLE = "".join(f"<p>{t}</p>" for t in TEXT)
AROUND = '<div class="nav"><a href=/>Home</a></div>{}<div class="comments"><p>We went there last summer, it was lovely.</p></div>'


@pytest.mark.parametrize("open_, shut", [
    ('<form id=aspnetForm method=post><input type=hidden name=__VIEWSTATE value=x><input name=q>', "</form>"), ('<form><div id="content">', "</div></form>"),
    ('<div class="main-sidebar-right"><article>', "</article></div>"), ('<div class="site-notices"><main>', "</main></div>"), ('<main><div class="page-widget"><article>', "</article></div></main>"),
    ('<div class="promo"><div itemprop="articleBody">', "</div></div>"), ('<form><input name=q><div class="site-search"><div role="main">', "</div></div></form>"),
])
def test_wrappers_of_the_page_do_not_outweigh_its_article(open_, shut):
    for page in (open_ + ARTICLE + shut, open_ + AROUND.format(ARTICLE) + shut, AROUND.format(open_ + ARTICLE + shut)):
        assert mainhtml.main_blocks(f"<body>{page}</body>") == TEXT


def test_teasers_and_forms_stay_boilerplate():
    form = "<form><label>Your name</label><input name=n><label>Your address</label><input name=a><p>Required fields are marked, all of them please.</p><button>Send</button></form>"
    teasers = '<div class="related"><article><p>The inn has a new cook this year.</p></article><article><p>The dam is closed until the spring.</p></article></div>'
    comment = '<section id=comments><article class="comment"><p>We went there last summer, it was lovely.</p></article><article><p>So did we, in the rain.</p></article></section>'
    assert mainhtml.main_blocks(f"<body><article>{ARTICLE}{comment}</article>{teasers}{form}</body>") == TEXT
    assert mainhtml.main_blocks(f"<body><div>{ARTICLE}</div>{teasers}{comment}{form}</body>") == TEXT


@pytest.mark.parametrize("page", ["", "   ", "<", "<p", "<p>", "<!-- open", "<script>x", "<a href='x", "&", "<div " * 50, "</div>" * 50, "<p a=\"" + "x" * 1000])
def test_broken_pages_do_not_fail(page):
    assert isinstance(mainhtml.main_blocks(page), list)


def test_page_cut_off_in_a_tag():
    assert mainhtml.main_blocks("<article><p>First words of a text. <p>Second &am") == ["First words of a text.", "Second &am"]
    assert mainhtml.main_blocks("<article><p>First words of a text.<p cla") == ["First words of a text."]


@pytest.mark.parametrize("open_, shut", [
    ('<section id="discussion">', "</section>"), ('<section id="related-work">', "</section>"), ('<div class="search-algorithms">', "</div>"), ('<div class="logo-history">', "</div>"),
    ('<div style="display:none">', "</div>"), ("<noscript>", "</noscript>"),
])
def test_topics_in_the_article_are_no_boilerplate(open_, shut):
    assert mainhtml.main_blocks(f"<body><article><h1>On ferries</h1>{ARTICLE}{open_}{ARTICLE}{shut}</article></body>") == ["On ferries", *TEXT, *TEXT]


@pytest.mark.parametrize("box", [
    '<div class="related"><a href=/a>The inn has a new cook this year, and he cooks well</a> <a href=/b>The dam is closed until the spring comes</a></div>',
    '<div class="social-share">Share this</div>', '<div class="search-box"><p>Search for it</p></div>', '<div class="cookie-notice"><p>' + TEXT[0] + "</p></div>", '<div class="ad-slot"><p>' + TEXT[1] + "</p></div>",
    '<section id="discussion" class="comments"><p>' + TEXT[0] + "</p></section>", '<div class="share-links"><p>' + TEXT[0] + "</p></div>",
])
def test_boxes_in_the_article_stay_boilerplate(box):
    assert mainhtml.main_blocks(f"<body><article>{ARTICLE}{box}</article></body>") == TEXT


def test_the_flow_changes_labels():
    """Short lines between paragraphs look like boilerplate each for itself; the cut keeps them with their neighbours, and the menu stays out."""
    lines = ["The way there", "By bus", "Line nine"]
    page = f"<body><ul class=menu><li>Home<li>News</ul><div><p>{TEXT[0]}<h2>{lines[0]}</h2><div>{lines[1]}</div><p>{TEXT[1]}</p><div>{lines[2]}</div><p>{TEXT[0]}</div><div class=footer>Imprint</div></body>"
    blocks = mainhtml.page_blocks(page)
    lean, links = [mainhtml.leaning(b) for b in blocks], mainhtml.edges(blocks)
    alone = [b.text for b, x in zip(blocks, lean, strict=True) if x > 0]
    assert not set(lines) & set(alone)
    assert mainhtml.main_blocks(page) == [TEXT[0], *lines[:2], TEXT[1], lines[2], TEXT[0]]
    open_ = [x for x in mainhtml.settled(lean, links)[0] if x < 0]
    assert mainhtml.cut(lean, links) == [x in (*TEXT, *lines) for x in (b.text for b in blocks)] and len(open_) <= len(blocks)


@pytest.mark.parametrize("piece", ["<center>x", "</foo>x", "<center></x>y", "<div><p>a", "<li>a", "<p><b>c"])
def test_deep_nesting_in_time(piece):
    start = time.process_time()
    mainhtml.main_blocks(piece * 50_000)
    assert time.process_time() - start < 10


def test_flow_over_many_open_blocks():
    luck = random.Random(5)
    n = 3000
    lean = [luck.uniform(-1, 1) for _ in range(n)]
    links = [(i, i + 1, 1.0) for i in range(n - 1)] + [(i, i + 7, 1.0) for i in range(n - 7)]
    start = time.process_time()
    got = mainhtml.cut(lean, links)
    assert time.process_time() - start < 20
    # No block, and no run of ten, can change its label for the better.
    base = energy(got, lean, links)
    for i in range(0, n, 150):
        for size in (1, 10):
            other = got[:i] + [not x for x in got[i : i + size]] + got[i + size :]
            assert energy(other, lean, links) >= base - 1e-9


def energy(labels, lean, links):
    cost = sum(max(0.0, -c) if k else max(0.0, c) for k, c in zip(labels, lean, strict=True))
    return cost + sum(w for i, j, w in links if labels[i] != labels[j])


@given(st.integers(0, 10**9))
@settings(max_examples=150, deadline=None)
def test_cut_is_minimal(seed):
    luck = random.Random(seed)
    n = luck.randint(1, 9)
    lean = [luck.uniform(-2, 2) for _ in range(n)]
    links = [(i, j, luck.uniform(0, 1.5)) for i in range(n) for j in range(i + 1, n) if luck.random() < 0.4]
    got = energy(mainhtml.cut(lean, links), lean, links)
    assert got == pytest.approx(min(energy(x, lean, links) for x in product((False, True), repeat=n)))


def test_many_attributes_and_blocks_in_time():
    page = "<article>" + "<p " + " ".join(f'a{i}="{i}"' for i in range(20_000)) + ">Some text. </p>" + "<p>More text here.</p>" * 20_000
    assert len(mainhtml.main_blocks(page)) == 20_001


def test_rows(spark):
    rows = [(1, "u", SHOP, 5), (2, None, None, 5), (None, "v", "", 5), (1, "u", SHOP, 5)]
    got = mainhtml.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert sorted((r.page_id or 0, r.url or "", r.n_chars == len(r.text), bool(r.text)) for r in got) == [(0, "v", True, False), (1, "u", True, True), (1, "u", True, True), (2, "", True, False)]
    assert mainhtml.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
