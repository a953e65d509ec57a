"""Threads, posts, feeds, captions, transcripts, tracks, catalogues, calls, search text."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weblode.functions import urls
from weblode.operators import platforms as P

# Two sailors' replies under a link post; one reply is empty, one has no depth, one holds a reply that holds a reply.
THREAD = """<div><shreddit-post author="moor_hen" post-title="Chart &amp; compass" post-type="link" content-href="https://charts.example/9" score="-2" comment-count="many"
 created-timestamp="2021-11-30T23:59:59Z" subreddit-prefixed-name="r/knots"></shreddit-post>
<section><shreddit-comment thingid="t1_z9" author="gull" score="0" permalink="/r/knots/c/z9" created="2021-12-01T00:00:01Z"><p>not the text</p><article id="t1_z9-comment-rtjson-content">
<ul><li>tie it</li><li>twice</li></ul></article>
<shreddit-comment thingid="t1_y8" author="tern" depth="1" score="7"><b id="t1_y8-comment-rtjson-content">why?</b>
<shreddit-comment thingid="t1_x7" author="gull" depth="2" score="1"><i id="t1_x7-comment-rtjson-content">so it holds</i></shreddit-comment></shreddit-comment></shreddit-comment>
<shreddit-comment thingid="t1_w6" author="crab" depth="0" score="4"><i id="t1_w6-comment-rtjson-content"> </i></shreddit-comment></section></div>"""


def test_thread(page):
    d = page(("https://www.reddit.com/r/knots/comments/n/", THREAD), ("https://www.reddit.com/r/knots/", "<shreddit-comment>x</shreddit-comment>"))
    (t,) = P.threads(d).collect()
    assert (t.title, t.community, t.author, t.score, t.announced, t.link, t.body) == ("Chart & compass", "r/knots", "moor_hen", "-2", None, "https://charts.example/9", "")
    assert [(c.author, c.depth, c.score, c.text, c.created) for c in t.comments] == [
        ("gull", 0, "0", "tie it twice", "2021-12-01"), ("tern", 1, "7", "why?", ""), ("gull", 2, "1", "so it holds", "")]
    assert t.comments[0].url == "https://www.reddit.com/r/knots/c/z9"
    lines = P.threads(d).select(P.thread_text()).first()[0].split("\n")
    depth = [len(x) - len(x.lstrip()) for x in lines if x.lstrip().startswith("- ")]
    assert depth == [0, 2, 4] and lines[0] == "# Chart & compass" and "https://charts.example/9" in " ".join(lines) and "3 loaded of ?" in " ".join(lines)


def test_listing_feed(spark):
    df = spark.createDataFrame([(0, "http://reddit.com/r/knots"), (1, "https://np.reddit.com/user/gull//?sort=new&x")], "i int, u string")
    got = [r[0] for r in df.orderBy("i").select(P.listing_feed_url(F.col("u"))).collect()]
    assert got == ["http://www.reddit.com/r/knots/.rss", "https://www.reddit.com/user/gull/.rss?sort=new&x"]


def record(name, text, **more):
    """A stored post with one link, one clip in three qualities and one picture."""
    clip = {"video_info": {"variants": [{"content_type": "application/x-mpegURL", "url": "m3u"}, {"content_type": "video/mp4", "bitrate": 5, "url": "low"}, {"content_type": "video/mp4", "bitrate": 50, "url": "high"}]}}
    return {
        "__typename": "Tweet", "id_str": f"77{len(name)}", "text": text, "user": {"name": name.title(), "screen_name": name}, "created_at": "2019-08-07T06:05:04Z",
        "entities": {"urls": [{"url": "https://t.co/L", "expanded_url": "https://long.example/?a=1"}]}, "mediaDetails": [clip, {"media_url_https": "https://pic.example/1"}],
    } | more


def test_posts(spark):
    quoted = record("tern", "calm &lt;sea&gt;", favorite_count=3, conversation_count=0)
    bodies = [
        record("gull", "read https://t.co/L then https://t.co/L", favorite_count=98_765, in_reply_to_screen_name="crab"), record("heron", "so true", quoted_tweet=quoted),
        {"__typename": "TweetTombstone"}, {"tombstone": {"text": {"text": " taken\n down "}}, "__typename": "TweetTombstone"},
    ]
    rows = [(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(8, ""), (9, "{}"), (10, "not json")]
    got = P.posts(spark.createDataFrame(rows, "id int, body string"), ["id"])
    r = {x.id: x for x in got.collect()}
    assert r[0].text == "read https://long.example/?a=1 then https://long.example/?a=1" and r[0].media == ["high", "https://pic.example/1"] and r[0].reply_to == "crab"
    assert (r[0].likes, r[0].replies, r[0].url, r[0].quoted_handle) == (98_765, None, "https://x.com/gull/status/774", None)
    assert (r[1].quoted_handle, r[1].quoted_author, r[1].quoted_text, r[1].quoted_likes, r[1].quoted_replies, r[1].quoted_created) == ("tern", "Tern", "calm <sea>", 3, 0, "2019-08-07T06:05:04Z")
    assert r[1].quoted_media == ["high", "https://pic.example/1"]
    assert r[2].reason.endswith("TweetTombstone") and r[3].reason.endswith(": taken down") and all(r[i].reason and r[i].text is None for i in (8, 9, 10))
    text = got.filter("id = 0").select(P.post_text()).first()[0]
    assert all(x in text for x in ("Gull", "@gull", "@crab", "98,765", "high", "https://x.com/gull/status/774")) and "None" not in text


def test_feeds(spark):
    rss = '<?xml version="1.0"?><rss><channel><title>R</title><item><title>a &amp; b</title><link>l1</link><pubDate>d1</pubDate><description>&lt;p&gt;x&lt;/p&gt; y</description></item><item><link>l2</link></item></channel></rss>'
    atom = '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>A</title><entry><title type="html">t</title><link rel="self" href="s"/><link rel="alternate" href="h"/><updated>u</updated><summary>s</summary><content type="html">c</content></entry></feed>'
    rdf = '<rdf:RDF xmlns:rdf="x"><channel><title>D</title></channel><item><title>q</title><link>k</link></item></rdf:RDF>'
    df = spark.createDataFrame([(1, rss), (2, atom), (3, rdf), (4, "<html></html>")], "id int, body string")
    got = [(r.id, r.feed_title, r.n, r.title, r.link, r.date, r.text) for r in P.feed_items(df, ["id"]).orderBy("id", "n").collect()]
    assert got == [
        (1, "R", 1, "a & b", "l1", "d1", "x y"), (1, "R", 2, "(untitled)", "l2", "", ""), (2, "A", 1, "t", "h", "u", "c"), (3, "D", 1, "q", "k", "", "")]


def test_broken_feeds(spark):
    rss = '<rss><channel><title>Fish & chips</title><item><title>salt&nbsp;& vinegar</title><link>l?a=1&b=2</link></item></channel></rss>'
    df = spark.createDataFrame([(1, rss), (2, "<rss><channel><item><title>cut"), (3, "<p>page</p>")], "id int, body string")
    assert [(r.id, r.link) for r in P.feed_items(df, ["id"]).collect()] == [(1, "l?a=1&b=2")]
    assert {r.id: r.reason for r in P.feed_problems(df, ["id"]).collect()} == {2: "no entry of the feed can be read", 3: "not a feed"}


def test_feed_discovery(spark):
    html = """<link rel='alternate' type='application/atom+xml' href='../a.xml'>"""
    df = spark.createDataFrame([(html, "https://e.example/x/y/"), ("<p>", "https://e.example/")], "h string, u string")
    got = [(r[0].feed, r[0].reason) for r in df.select(P.discovered_feed(F.col("h"), F.col("u"))).collect()]
    assert got == [("https://e.example/x/a.xml", None), (None, "no feed is advertised")]


def plain_choice(manual, auto, language, prefs, explicit):
    """The same choice by trying pools and languages one after the other."""
    made = [k for k in manual if k != "live_chat"]
    spoken = (language or "").split("-")[0]
    pools = [("asked", made, False), ("asked", auto, True), ("own", made, False), ("own", auto, True)]
    order = [0, 1, 2, 3] if explicit else [2, 0, 3, 1]
    for i in order:
        which, pool, automatic = pools[i]
        names = list(prefs) if which == "asked" else ([f"{spoken}-orig"] if automatic else []) + [spoken] if spoken else []
        for name in names:
            exact = [k for k in pool if k == name]
            near = [k for k in pool if k.split("-")[0] == name]
            if exact or near:
                return (exact or near)[0], automatic
    return (made[0], False) if made else None


def test_track_choice_is_the_search_in_order(spark):
    luck = random.Random(12)
    names = ["nl", "nl-BE", "pt", "pt-orig", "da", "live_chat", "nl-orig", "fo"]
    for prefs, explicit in ((["nl"], False), (["nl"], True), (["da", "pt"], False), (["da", "pt"], True), (["zz"], True)):
        rows = [(i, luck.sample(names, luck.randint(0, 4)), luck.sample(names[:5], luck.randint(0, 4)), luck.choice(["nl", "pt-BR", "is", "", None])) for i in range(60)]
        df = spark.createDataFrame(rows, "i int, m array<string>, a array<string>, l string")
        got = {r.i: r.t and (r.t.key, r.t.automatic) for r in df.select("i", P.pick_track(F.col("m"), F.col("a"), F.col("l"), prefs, explicit).alias("t")).collect()}
        assert got == {i: plain_choice(m, a, lang, prefs, explicit) for i, m, a, lang in rows}


def test_vtt(spark):
    vtt = """WEBVTT - made by hand\nLanguage: da\nNOTE nothing\n\n1\n10:02.250 --> 10:04.000 align:start\n<v Skipper>Hoist &lt;the&gt; sail\n\n2\n10:04.000 --> 10:05.000\nHoist &lt;the&gt; sail\n<i>now</i>\n\n02:00:00.999 --> 02:00:01.000\nHoist &lt;the&gt; sail\n"""
    got = P.captions_vtt(spark.createDataFrame([(1, vtt)], "id int, vtt string"), ["id"]).orderBy("pos").collect()
    assert [(r.t, r.text) for r in got] == [(0.0, "1"), (602.0, "Hoist <the> sail"), (602.0, "2"), (604.0, "Hoist <the> sail"), (604.0, "now"), (7200.0, "Hoist <the> sail")]


def test_json3(spark):
    body = '{"events":[{"tStartMs":500,"segs":[{"utf8":"a "},{"utf8":"b"}]},{"tStartMs":900},{"segs":[{"utf8":"\\n"}]},{"tStartMs":2000,"segs":[{"utf8":"c"}]}]}'
    got = P.captions_json3(spark.createDataFrame([(1, body)], "id int, json3 string"), ["id"]).orderBy("pos").collect()
    assert [(r.t, r.text) for r in got] == [(0.5, "a b"), (2.0, "c")]


@pytest.mark.parametrize("seed", range(3))
def test_transcript_properties(spark, seed):
    """Words stay whole and in order, paragraphs end where they may, every begun chapter has its head before what it covers."""
    luck = random.Random(seed)
    times = sorted(luck.uniform(0, 3000) for _ in range(160))
    lines = [(t, " ".join("sail" + "s" * luck.randrange(5) for _ in range(luck.randint(1, 25))) + luck.choice(["", ".", "?", "…", ","])) for t in times]
    chapters = sorted({float(luck.randrange(3600)) for _ in range(7)})
    caps = spark.createDataFrame([(1, i, t, x) for i, (t, x) in enumerate(lines)], "id int, pos int, t double, text string")
    chs = spark.createDataFrame([(1, i, s, f"Leg {i}") for i, s in enumerate(chapters)], "id int, pos int, start double, title string")
    got = [r.line for r in P.transcript(caps, chs, ["id"]).orderBy("at", "rank", "n").collect()]
    body = [x for x in got if not x.startswith("### ")]
    assert " ".join(x.split("] ", 1)[1] for x in body) == " ".join(x for _, x in lines)
    begun = [i for i, s in enumerate(chapters) if s <= times[-1]]
    assert [x.split(" (")[0] for x in got if x.startswith("### ")] == [f"### Leg {i}" for i in begun]
    # Cut the lines again at the paragraphs found: each paragraph covers whole captions of one chapter.
    at = 0
    for i, x in enumerate(got):
        if x.startswith("### "):
            continue
        text, first, size = x.split("] ", 1)[1], at, 0
        while size < len(text):
            size += len(lines[at][1]) + 1
            at += 1
        assert size == len(text) + 1
        assert len({sum(s <= t for s in chapters) for t, _ in lines[first:at]}) == 1
        # It goes on until it is long and a sentence ends, or until it is very long.
        before = size - len(lines[at - 1][1]) - 1
        assert before < P.PARAGRAPH_HARD and not (before >= P.PARAGRAPH_SOFT and lines[at - 2][1][-1] in ".!?…" and at - 2 >= first)
        ended = size >= P.PARAGRAPH_HARD or size >= P.PARAGRAPH_SOFT and text[-1] in ".!?…"
        assert ended or i + 1 == len(got) or got[i + 1].startswith("### ") or sum(s <= lines[at][0] for s in chapters) > sum(s <= lines[at - 1][0] for s in chapters)
    assert at == len(lines)


def test_catalogue(spark):
    product = {"title": "P", "handle": "p", "tags": ["x", "y"], "images": [], "variants": [
        {"title": "a", "price": "3.50", "available": False}, {"title": "b", "price": "0.00", "available": True}, {"title": "c"}]}
    bare = {"title": "Q", "handle": "q", "tags": "one, two"}
    pages = spark.createDataFrame([
        ("https://s.example", 1, json.dumps({"products": [product] * 249 + [bare]})), ("https://s.example", 2, json.dumps({"products": [product]})),
        ("https://s.example", 3, json.dumps({"products": [bare]})), ("https://t.example", 1, "<html>")], "store string, page_no int, body string")
    cat = P.catalogue_pages(pages)
    assert cat.filter(F.col("products").isNull()).count() == 1
    kept = P.catalogue_pages(P.until_short_page(pages.filter("store = 'https://s.example'")))
    rows = P.products(kept).collect()
    assert len(rows) == 251
    p = next(r for r in rows if r.title == "P")
    assert (p.price_min, p.price_max, p.variants, p.available, p.tags, p.url) == (0.0, 3.5, 3, True, "x, y", "https://s.example/products/p")
    q = next(r for r in rows if r.title == "Q")
    assert (q.price_min, q.variants, q.available, q.tags) == (None, 0, False, "one, two")
    assert P.variants(kept).count() == 750


def test_calls_and_search_text(spark):
    calls = spark.createDataFrame([("u1", 200, "application/json", '{"a": 1}'), ("u2", 200, "text/plain", "é" * 6000)], "url string, status int, media string, body string")
    got = {r.url: r for r in P.captured_calls(calls, []).collect()}
    assert got["u1"].json == '{"a": 1}' and got["u1"].text is None and got["u2"].bytes == 12000 and len(got["u2"].text) == 5000
    text = "Title: A\nURL: https://a.example/\nPublished: 2024\nText: URL: no\n\nTitle: B\nURL: https://b.example/\n"
    rec = P.search_records(spark.createDataFrame([(1, text), (2, "nothing")], "q int, text string"), ["q"]).orderBy("n").collect()
    assert [(r.n, r.title, r.url, r.published) for r in rec] == [(1, "A", "https://a.example/", "2024"), (2, "B", "https://b.example/", None)]


def test_repositories(spark):
    body = json.dumps({"full_name": "o/r", "stargazers_count": 5, "license": None, "topics": ["a", "b"], "created_at": "2020-01-02T00:00:00Z", "homepage": ""})
    r = P.repositories(spark.createDataFrame([(1, body)], "id int, body string"), ["id"]).first()
    assert (r.stars, r.forks, r.license, r.language, r.topics, r.created, r.homepage, r.readme) == (5, 0, "—", "—", "a, b", "2020-01-02", None, "(no README)")
    name = spark.createDataFrame([("https://github.com/o/r.git",)], "u string").select(P.repo_name(urls.path("u"))).first()[0]
    assert name == "o/r"
