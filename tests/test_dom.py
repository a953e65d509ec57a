"""Node arrays, selectors, extraction and rendering."""

import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from weblode.operators import dom, extract, platforms, relocate
from weblode.operators.corpus import csv_ready
from weblode.operators.select import Field, Pick, Step, extract_rows, select, values
from weblode.operators.tree import close_elements

HERE = "https://port.example/boats/list.html"
# A harbour register: berths as table rows, with definition lists inside.
HARBOUR = """<!doctype html><html lang="nl"><head><title>Harbour register</title></head><body>
<section id="berths"><table>
<tr class="berth deep" data-no="4"><td class="boat">Albatros</td><td><dl><dt>Length<dd class="m">12.5<dt>Flag<dd>NL</dl></td><td><a href="../b/4?x=1#log" rel="log">log</a></td></tr>
<tr class="berth" data-no="7"><td class="boat">Brent &amp; Co</td><td><dl><dt>Length<dd class="m">8</dl></td><td><a href="/b/7">log</a> <a href="/b/7/photos">photos</a></td></tr>
<tr class="berth"><td></td></tr></table></section>
<p>Older lists: <a class="older" href="list.html?year=1999">1999</a></p></body></html>"""
STORY = " ".join(f"Sentence {i} tells of the sea." for i in range(40))

marks = st.lists(
    st.sampled_from(["", "+div", "-div", "+p", "-p", "+b", "-b", ".br", "+li", "-li", "+ul", "-ul", "+table", "-table", "+tr", "+td", "-td", "!div", "+section", "-section"]),
    max_size=60,
)


@given(marks)
@settings(max_examples=300, deadline=None)
def test_spans_nest(seq):
    end, parent, depth, nth, hidden = close_elements(seq)
    spans = [(i, end[i]) for i, m in enumerate(seq) if m[:1] in ("+", "!")]
    for a, ea in spans:
        for b, eb in spans:
            if a < b < ea:
                assert eb <= ea
    for i, m in enumerate(seq):
        if m[:1] != "-":
            holders = [a for a, ea in spans if a < i < ea]
            assert parent[i] == (max(holders) if holders else -1)
            assert depth[i] == len(holders)


def test_implied_ends():
    end, parent, *_ = close_elements(["+dl", "+dt", "", "+dd", "", "+dt", "-dl", "+select", "+option", "", "+option", "-select"])
    assert (end[1], end[3], end[5], end[0]) == (3, 5, 6, 6) and (end[8], end[10]) == (10, 11)
    # Nested lists keep their items apart.
    end, parent, *_ = close_elements(["+ol", "+li", "+ul", "+li", "-ul", "+li", "-ol"])
    assert end[1] == 5 and end[3] == 4 and parent[5] == 0
    # An end tag that crosses a stronger element is ignored, one that crosses a weaker one ends it.
    end, parent, *_ = close_elements(["+i", "+table", "-i", "-table", "-i"])
    assert parent[2] == -1 and end[1] == 3 and end[0] == 4


def test_tokens_give_the_page_back(spark):
    cases = [HARBOUR, "1 < 2 & <b>3</B>", "<style>a>b{}</style ><!-- - > --><q cite='>'>", "<i title='open>text</i>", "", "<<", "<?php echo ?><m:n/>"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, html string")
    for row in df.select("html", dom.tokens("html").alias("t")).collect():
        assert "".join(x.raw for x in row.t) == row.html


def test_hostile_pages_end_no_task(spark):
    """Long tags, long strings, unclosed quotes and big scripts are lexed without recursion."""
    cases = [
        "<div " + " ".join(f'a{i}="{i}"' for i in range(50_000)) + ">x</div>",
        "<div " + " ".join(f"a{i}='{i}'" for i in range(20_000)) + "x",
        '<a title="' + "never closed " * 20_000,
        "<script>" + "var a = '<b>'; " * 100_000 + "</script>",
    ]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "page_id int, html string")
    got = df.select("html", dom.tokens("html").alias("t")).collect()
    assert all("".join(x.raw for x in r.t) == r.html for r in got)
    many = dom.with_nodes(df.filter("page_id = 0")).select(F.size(F.get("nodes", F.lit(0))["attrs"])).first()[0]
    assert many == 50_000


def test_attributes(page):
    d = page((HERE, """<option VALUE=a&lt;b label = 'two words' selected data-x="it's" data-x="again">t"""))
    n = d.select(F.explode(select("nodes", [Step(tag="option")])).alias("n")).first().n
    assert [(a.name, a.value) for a in n.attrs] == [("value", "a<b"), ("label", "two words"), ("selected", ""), ("data-x", "it's"), ("data-x", "again")]


def test_rows(page):
    d = page((HERE, HARBOUR))
    berths = [(Step(tag="tr", classes=("berth",)),)]
    fields = [
        Field("boat", Pick(((Step(classes=("boat",)),),), "own")), Field("metres", Pick(((Step(tag="dd", classes=("m",)),),))),
        Field("log", Pick(((Step(tag="a"),),), "attr:href")), Field("facts", Pick(((Step(tag="dd"),),), "own"), many=True),
    ]
    got = extract_rows(d, fields, each=berths, keep=()).orderBy("_row").collect()
    assert [(r.boat, r.metres, r.log, r.facts) for r in got] == [
        ("Albatros", "12.5", "https://port.example/b/4?x=1#log", ["12.5", "NL"]), ("Brent & Co", "8", "https://port.example/b/7", ["8"])]
    flat = csv_ready(extract_rows(d, [fields[0], fields[3]], each=berths, keep=()))
    assert flat.filter("_row = 1").first().facts == "12.5; NL"
    assert extract_rows(d, fields, each=berths, limit=1).count() == 1
    # Without a row rule the page is the row, and stays even when nothing is found.
    one = extract_rows(d, [Field("owner", Pick(((Step(id="owner"),),))), Field("lang", Pick(((Step(tag="html"),),), "attr:lang"))], keep=()).collect()
    assert [(r._row, r.owner, r.lang) for r in one] == [(1, None, "nl")]


def test_selector_operators(page):
    d = page((HERE, HARBOUR))

    def texts(*path):
        return d.select(F.transform(select("nodes", list(path)), lambda n: dom.subtree_text("nodes", n))).first()[0]

    list_ = Step(tag="dl")
    assert texts(Step(id="berths"), Step(tag="dd")) == ["12.5", "NL", "8"]
    assert texts(list_, Step(tag="dd", child=True)) == ["12.5", "NL", "8"] and texts(Step(tag="tr"), Step(tag="dd", child=True)) == []
    assert texts(list_, Step(tag="dt", nth=3, child=True)) == ["Flag"]
    assert texts(Step(attrs=(("href", "^=", "/b/7"),))) == ["log", "photos"]
    assert texts(Step(attrs=(("href", "$=", "photos"),))) == ["photos"]
    assert texts(Step(attrs=(("href", "*=", "year"),))) == ["1999"]
    assert texts(Step(tag="a", attrs=(("rel", "not", None), ("class", "not", None)))) == ["log", "photos"]
    assert texts(Step(tag="tr", classes=("deep",)), Step(tag="a")) == ["log"]


def test_values(page):
    d = page((HERE, HARBOUR))
    assert d.select(values("nodes", Pick(((Step(tag="a", classes=("older",)),),), "attr:href"), "url")).first()[0] == ["https://port.example/boats/list.html?year=1999"]
    assert d.select(values("nodes", Pick(((Step(classes=("boat",)),),), "own"), "url")).first()[0] == ["Albatros", "Brent & Co"]


def test_links(page):
    more = '<a href="https://sea.example/x">s</a><a href="ftp://port.example/f">f</a><a href="">self</a><a href="//img.port.example/1">i</a><a href="../b/4?x=1">twice</a>'
    got = {r.url: r for r in extract.links(page((HERE, HARBOUR + more))).collect()}
    assert set(got) == {
        "https://port.example/b/4?x=1", "https://port.example/b/7", "https://port.example/b/7/photos", "https://port.example/boats/list.html?year=1999",
        "https://sea.example/x", HERE, "https://img.port.example/1"}
    assert got["https://port.example/b/4?x=1"].text == "log" and got["https://img.port.example/1"].same_site and not got["https://sea.example/x"].same_site
    assert extract.links(page((HERE, HARBOUR + more)), same_site=True, match="/b/").count() == 3
    assert [r.text for r in extract.links(page((HERE, HARBOUR)), limit=3).orderBy("pos").collect()] == ["log", "log", "photos"]


def test_metadata(page):
    html = """<html lang=pt><head><meta name=description content="tides
    and ports"><title>  Ports &gt; tides </title><link rel=canonical href=https://port.example/c><meta property=og:type content=site><meta name=twitter:site content=@a>
    <meta name=twitter:site content=@b><link rel=alternate type=application/rss+xml href=news.rss><script type=application/ld+json>[1]</script><script type=application/ld+json>{,}</script></head>"""
    m = extract.metadata(page((HERE, html + "<h1>a</h1>" * 2 + "<h1>b <i>c</i></h1>"))).first()
    assert (m.title, m.description, m.canonical, m.lang) == ("Ports > tides", "tides and ports", "https://port.example/c", "pt")
    assert m.social == {"og:type": "site", "twitter:site": "@b"} and m.h1 == ["a", "a", "b c"]
    assert m.feeds == ["https://port.example/boats/news.rss"] and m.jsonld == ["[1]"]
    bare = extract.metadata(page((HERE, "<p>x"))).first()
    assert (bare.title, bare.description, bare.h1, bare.social, bare.feeds) == (None, None, [], {}, [])


def test_embedded_data(page):
    html = """<script type="application/json" id="cfg">{"v": 1}</script><script type="application/json" id="cfg">{"v": 2}</script><script type="application/json" id="cfg">{"v": </script>
    <script id="__NUXT_DATA__">[0]</script><script type="application/json">7</script>
    <script>__BOATS_A__ = [{"n": "a]}\\\\"}, 2]; var x = 1; window.__PORT_9__={"deep": {"er": []}} /* } */;</script><script>__BOATS_A__ = ["newer"]</script>
    <script>window.__CUT_OFF__ = {"a": [1, 2}</script><script src=x>__FROM_SRC__ = {}</script>"""
    d = page((HERE, html))
    assert [(r.key, r.body) for r in extract.json_scripts(d).collect()] == [("cfg", '{"v": 2}'), ("__NUXT_DATA__", "[0]"), ("json_4", "7")]
    assert {(r.key, r.body) for r in extract.state_assignments(d).collect()} == {("__BOATS_A__", '["newer"]'), ("__PORT_9__", '{"deep": {"er": []}}')}


def test_focus(page):
    part = lambda mark: f"<body><p>menu</p>{mark.format(STORY)}<p>end</p></body>"
    marks = {
        "main": "<main>{}</main>", "[role=main]": "<div role=main>{}</div>", "article": "<article>{}</article>", "#main-content": "<div id=main-content>{}</div>", "#main": "<div id=main>{}</div>",
        "#content": "<div id=content>{}</div>", ".main-content": "<div class=main-content>{}</div>", ".post-content": "<div class='x post-content'>{}</div>",
        ".entry-content": "<div class=entry-content>{}</div>", ".article-body": "<div class=article-body>{}</div>",
    }
    pages = [(HERE, part(m)) for m in marks.values()]
    none = [(HERE, part("<main>{}</main><main>x</main>")), (HERE, "<main>short</main>"), (HERE, f"<main>little</main><p>{STORY}</p>")]
    got = [r.rule for r in extract.with_focus(page(*pages, *none)).orderBy("page_id").select("focus.rule").collect()]
    assert got == [*marks, None, None, None]


def test_markdown(page):
    html = f"""<title>Log</title><body><header>top</header><article><h2>Day <em>one</em></h2><p>{STORY}</p><ol><li>cast off<li>set <code>sail</code></ol>
    <p>See <a href="../chart?n=1">the <strong>chart</strong></a>.<br>Then rest.</p><img src=/i.png alt=map><hr><pre>a
  b</pre></article></body>"""
    doc = extract.documents(page((HERE, html))).first()
    assert doc.focus == "article" and doc.title == "Log" and doc.reason is None
    for piece in ("## Day *one*\n\n", "- cast off\n- set `sail`", "See [the **chart**](https://port.example/chart?n=1).\nThen rest.", "![map](https://port.example/i.png)", "\n\n---\n\n", "```\na"):
        assert piece in doc.markdown
    assert "top" not in doc.markdown
    assert "top" in extract.documents(page((HERE, html)), full_page=True).first().markdown
    assert "#" not in extract.documents(page((HERE, html)), text=True).first().markdown


def test_hidden_parts(page):
    html = f"""<article><p>{STORY}</p><section style="display:none"><p>draft one</p></section><span style='VISIBILITY : hidden'>draft two</span>
    <ul hidden><li>draft three</ul><p aria-hidden=true>draft four</p><p data-hidden>sh​own</p></article>"""
    doc = extract.documents(page((HERE, html))).first()
    assert "draft" not in doc.markdown and "shown" in doc.markdown
    nothing = extract.documents(page((HERE, "<body><section hidden>all of it</section></body>"))).first()
    assert nothing.reason is not None


def test_plain_text(page):
    assert page((HERE, "<ul><li> one <li>two<!-- no --><style>no</style></ul>tail")).select(extract.visible_text()).first()[0] == "one\ntwo\ntail"


def test_find_by_text(page):
    d = page((HERE, "<title>Log</title><h1> Log </h1><p>Log <b>book</b></p><i>log</i><div><u>x</u>Log</div>"))
    got = extract.find_by_text(d, dom.page_title()).orderBy("pos").collect()
    assert [r.tag for r in got] == ["title", "h1", "p", "div"]
    assert extract.find_by_text(d, F.lit("")).count() == 0


def test_outline(page):
    lines = [r.text for r in extract.outline(page((HERE, HARBOUR)), max_depth=4).orderBy("line").collect()]
    assert lines[0] == "body" and lines[1].startswith("  section#berths (") and lines[2].startswith("    table (")
    assert sum("tr.berth.deep (" in x for x in lines) == 1 and any(x.startswith("      tr.berth ×2 (") for x in lines)
    assert any("td.boat" in x and "“Albatros”" in x for x in lines) and not any("dd" in x for x in lines)
    many = "<body>" + "".join(f"<p id=n{i}><i>x</i></p>" for i in range(30)) + "</body>"
    # Lines beyond the limit are listed, but what is in them is not.
    assert extract.outline(page((HERE, many)), max_lines=21).count() == 1 + 30 + 10


def test_tables(page):
    html = "<table><tbody><tr><th>Port<td>Depth</tbody><tr><td>A<td><table><tr><td>in</table></table>"
    got = [(r.table, r.row, r.cell, r.header, r.text) for r in platforms.table_cells(page((HERE, html))).orderBy("table", "row", "cell").collect()]
    assert got == [(1, 1, 1, True, "Port"), (1, 1, 2, False, "Depth"), (1, 2, 1, False, "A"), (1, 2, 2, False, "in"), (2, 1, 1, False, "in")]


def test_relocation(page):
    long = " ".join(f"w{i}" for i in range(60))
    old = page((HERE, f"<div><p class=a>{long} old</p><p class=a>{long} keep this one</p></div>"))
    new = page((HERE, f"<section><div><p class='a b'>{long} other end</p><p class='a b'>{long} keep this one</p></div></section>"))
    wanted = F.slice(select("nodes", [Step(tag="p")]), 2, 1)
    saved = relocate.fingerprints(old, wanted, ["url"], F.lit("text"))
    got = relocate.relocate(saved, relocate.candidates(new, ["url"]), ["url"], threshold=0.3).collect()
    # The two differ only far beyond their first words.
    node = new.select(F.get(select("nodes", [Step(tag="p")]), F.lit(1))["pos"]).first()[0]
    assert [(r.name, r.pos) for r in got] == [("text", node)]
    assert relocate.relocate(saved, relocate.candidates(new, ["url"]), ["url"], threshold=0.99).count() == 0


@pytest.mark.parametrize("body", ['[[{"k": "]"}], 3] , 4', '{"a": "\\\\"}{"b": 1}', "[1, 2", '{"a" 1}', "{}", " [1]", '["' + "x" * 70_000 + '"] y', '["' + '\\"' * 200_000 + '"]z', '{"a": "' + "}" * 66_000 + '"}'])
def test_first_json(spark, body):
    try:
        obj, end = json.JSONDecoder().raw_decode(body)
        want = body[:end] if body[:1] in ("[", "{") else None
    except ValueError:
        want = None
    assert spark.createDataFrame([(body,)], "b string").select(extract.first_json("b")).first()[0] == want
