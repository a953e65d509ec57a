"""Sitemaps, pagination, reach, robots, sinks, streams."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from weblode.operators import corpus, graph
from weblode.sources import responses, sinks, sitemaps
from weblode.streaming import jobs, runs


def test_sitemaps(spark, tmp_path):
    docs = {
        "https://a.example/sitemap.xml": "<sitemapindex><sitemap><loc>https://a.example/one.xml</loc></sitemap><loc>https://a.example/sitemap.xml</loc><loc>https://a.example/two.xml</loc></sitemapindex>",
        "https://a.example/one.xml": "<urlset><url><loc> https://a.example/p?a=1&amp;b=2 </loc></url><url><loc><![CDATA[https://a.example/q]]></loc></url><loc>https://a.example/two.xml</loc></urlset>",
        "https://a.example/two.xml": "<urlset><loc>https://a.example/q</loc><loc>https://a.example/r</loc></urlset>",
    }
    d = spark.createDataFrame(list(docs.items()), "doc_url string, body string")
    robots = spark.createDataFrame([("https://a.example", None), ("https://b.example", "User-agent: *\nSitemap: https://a.example/two.xml\n")], "site string, body string")
    roots = graph.sitemap_roots(robots)
    assert roots.filter("site = 'https://a.example'").count() == 3

    def listed(**kw):
        rows = graph.expand_sitemaps(roots, d, **kw).orderBy("site", "path").collect()
        return [r.url.rsplit("/", 1)[1] for r in rows if r.site == "https://a.example"], [r.url for r in rows if r.site == "https://b.example"]

    assert listed() == (["p?a=1&b=2", "q", "r"], ["https://a.example/q", "https://a.example/r"])
    assert listed(match="/[qr]$", limit=1) == (["q"], ["https://a.example/q"])
    assert listed(max_docs=2)[0] == ["p?a=1&b=2", "q", "two.xml"]
    path = tmp_path / "s.xml.gz"
    path.write_bytes(gzip.compress(docs["https://a.example/two.xml"].encode()))
    body = sitemaps.sitemap_files(spark, str(path)).first().body
    assert spark.range(1).select(graph.locations(F.lit(body))).first()[0] == ["https://a.example/q", "https://a.example/r"]


def test_pagination(spark):
    pages = spark.createDataFrame(
        [("1", "2", True), ("2", "3", True), ("3", "1", True), ("a", "b", True), ("b", "c", False), ("c", None, True), ("x", "x", True), ("z", None, False)],
        "url string, next_url string, usable boolean")
    starts = spark.createDataFrame([("1",), ("a",), ("x",), ("z",), ("missing",)], "url string")
    got = sorted((r.start, r.page_no, r.url) for r in graph.paginate(starts, pages, 5).collect())
    assert got == [("1", 1, "1"), ("1", 2, "2"), ("1", 3, "3"), ("a", 1, "a"), ("x", 1, "x")]
    assert graph.paginate(starts, pages, 2).filter("start = '1'").count() == 2


def test_paginate_takes_one_row_of_a_url(spark):
    """A URL stored twice neither branches a chain nor repeats its pages."""
    pages = spark.createDataFrame(
        [(5, "a", "wrong", True), (1, "a", "b", True), (2, "b", "c", True), (2, "b", "c", True), (3, "c", "d", True), (9, "c", "a", True), (4, "d", "e", False), (8, "d", "e", True), (6, "wrong", None, True)],
        "page_id long, url string, next_url string, usable boolean")
    starts = spark.createDataFrame([("a",), ("a",), ("wrong",)], "url string")
    got = sorted((r.start, r.page_no, r.url) for r in graph.paginate(starts, pages, 9).collect())
    assert got == [("a", 1, "a"), ("a", 2, "b"), ("a", 3, "c"), ("wrong", 1, "wrong")]


def test_paginate_doubles(spark):
    """Random chains with loops and tails against a walk; a chain of 1,500 pages takes 11 rounds, not 1,500."""
    import random

    rng = random.Random(4)
    to = {str(i): (str(rng.randrange(300)) if rng.random() < 0.97 else None) for i in range(300)} | {f"l{i}": f"l{i + 1}" for i in range(1600)}
    pages = spark.createDataFrame([(u, n, u != "7") for u, n in to.items()], "url string, next_url string, usable boolean")
    firsts = [str(i) for i in range(0, 300, 3)] + ["l0", "l1599", "l1600"]
    for cap in (1, 2, 3, 7, 64, 1500):
        want = []
        for s in firsts:
            at, trail = s, []
            while at in to and at != "7" and at not in trail and len(trail) < cap:
                trail.append(at)
                at = to[at]
            want += [(s, i + 1, u) for i, u in enumerate(trail)]
        starts = spark.createDataFrame([(s,) for s in firsts], "url string")
        assert sorted((r.start, r.page_no, r.url) for r in graph.paginate(starts, pages, cap).collect()) == sorted(want)


def test_accumulated_has_one_order(spark):
    chain = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b"), ("t", 1, "b"), ("u", 1, "none")], "start string, page_no int, url string")
    rows = spark.createDataFrame([("a", 1, "y"), ("a", 1, "x"), ("b", 2, "n"), ("b", 1, "m"), ("b", 3, "o")], "url string, _row int, v string")
    got = sorted((r.start, r.page_no, r._row, r.v) for r in graph.accumulated(chain, rows, limit=3).collect())
    assert got == [("s", 1, 1, "x"), ("s", 1, 1, "y"), ("s", 2, 1, "m"), ("t", 1, 1, "m"), ("t", 1, 2, "n"), ("t", 1, 3, "o")]
    assert graph.accumulated(chain, rows).count() == 8


def test_robots(spark):
    body = "User-agent: bad\nDisallow: /\n\nUser-Agent: *\nDisallow: /a\nAllow: /a/b # note\nDisallow:\nDisallow: /*.pdf\nAllow: /same\nDisallow: /same\n"
    rules = graph.robots_rules(spark.createDataFrame([("e.example", body)], "host string, body string"))
    assert rules.count() == 5
    paths = {"/": True, "/a": False, "/a/b/c": True, "/ax": False, "/x/y.pdf?z": False, "/same": True}
    df = spark.createDataFrame([("https://e.example" + p,) for p in paths] + [("https://other.example/a",)], "url string")
    got = {r.url for r in graph.allowed_by_robots(df, rules).collect()}
    assert got == {"https://e.example" + p for p, ok in paths.items() if ok} | {"https://other.example/a"}


def test_robots_groups(spark):
    """Shared groups, repeated groups, comments, case, fall-back, patterns."""
    files = {
        "shared": "User-agent: *\nUser-agent: heron # both\nDisallow: /nest\n",
        "twice": "user-agent:HERON\nDisallow: /a\n\nUser-agent: *\nDisallow: /\n\nUser-Agent: Heron\r\nDisallow: /b$\nCrawl-delay: 3\nAllow: /a/ok\n",
        "other": "User-agent: gull\nDisallow: /\n", "star": "# all\nUser-agent: *\nDisallow:\nDisallow: /x*y\n", "none": "", "dot": "User-agent: her.n\nDisallow: /\n",
    }
    rules = graph.robots_rules(spark.createDataFrame(list(files.items()), "host string, body string"), "heron")
    got = {}
    for r in rules.collect():
        got.setdefault(r.host, set()).add((r.rule, r.allow))
    assert got == {"shared": {("/nest", False)}, "twice": {("/a", False), ("/b$", False), ("/a/ok", True)}, "star": {("/x*y", False)}}
    asked = [("twice", "/a"), ("twice", "/a/ok/1"), ("twice", "/b"), ("twice", "/bb"), ("star", "/x/1/y2"), ("star", "/x"), ("other", "/"), ("shared", "/nest.html")]
    df = spark.createDataFrame([(f"https://{h}{p}",) for h, p in asked], "url string")
    ok = {r.url for r in graph.allowed_by_robots(df, rules).collect()}
    assert ok == {"https://twice/a/ok/1", "https://twice/bb", "https://star/x", "https://other/"}


def test_nothing_is_cut_at_a_depth(spark):
    n = 60
    docs = [(f"https://a.example/{i}.xml", f"<sitemapindex><loc>https://a.example/{i + 1}.xml</loc></sitemapindex>") for i in range(n)]
    docs.append((f"https://a.example/{n}.xml", "<urlset><loc>https://a.example/deep</loc></urlset>"))
    roots = spark.createDataFrame([("https://a.example", 0, "https://a.example/0.xml")], "site string, pos int, url string")
    got = graph.expand_sitemaps(roots, spark.createDataFrame(docs, "doc_url string, body string"))
    assert [r.url for r in got.collect()] == ["https://a.example/deep"]


def crawl(start, links, allow=None):
    seen, order, front = {start}, [], [start]
    while front:
        order += front
        front = sorted({b for a in front for b in links.get(a, ()) if b in links and b not in seen and ".e.example" in "." + b})
        seen |= set(front)
    return order


def test_reach_and_resume(spark):
    rnd = random.Random(11)
    names = [f"https://h{i}.e.example/p" for i in range(30)] + ["https://off.example/p"]
    links = {n: rnd.sample(names, 2) for n in names}
    rows = [(a, i, b) for a, bs in links.items() for i, b in enumerate(bs)] + [(names[0], 9, "https://h99.e.example/not-stored")]
    df = spark.createDataFrame(rows, "source string, pos int, url string")
    starts = spark.createDataFrame([("e.example", names[0])], "domain string, url string")
    want = crawl(names[0], {a: [b for b in bs if "off." not in b] for a, bs in links.items()})
    full = graph.reach(starts, df)
    assert {r.url for r in full.collect()} == set(want)
    part = graph.reach(starts, df, max_pages=5)
    assert part.count() == 5
    # Going on from the queue reaches the rest; going on twice adds nothing.
    rest = graph.reach(graph.frontier(part, df), df, visited=part)
    both = {r.url for r in part.collect()} | {r.url for r in rest.collect()}
    assert both == set(want) and not {r.url for r in part.collect()} & {r.url for r in rest.collect()}
    assert graph.reach(graph.frontier(full, df), df, visited=full).count() == 0
    denied = graph.reach(starts, df, deny=[r"h1\d\."])
    assert not [r.url for r in denied.collect() if "//h1" in r.url and len(r.url) > 22 and r.url[9:11].isdigit()]
    with pytest.raises(ValueError):
        graph.reach(starts, df, allow=["*bad"])


def test_manifest(spark):
    m = spark.createDataFrame([("a.example",)], "domain string")
    graph.check_manifest(m, "a.example")
    with pytest.raises(ValueError):
        graph.check_manifest(m, "b.example")


def test_follow_rules(spark):
    df = spark.createDataFrame([("https://e/a/1",), ("https://e/b/1",), ("https://e/c",)], "url string")
    assert sorted((r.url, r.kind) for r in graph.follow_rules(df, [("/a/", "A"), (r"/\w/\d", "other")]).collect()) == [("https://e/a/1", "A"), ("https://e/b/1", "other")]


def test_corpus_files(spark, tmp_path):
    rows = [(1, "https://e/a", "A", "x"), (2, "https://e/b", None, "yy"), (3, "https://e/a", "A2", "zzz")]
    df = spark.createDataFrame(rows, "seq int, url string, title string, markdown string")
    sinks.append_corpus(df.filter("seq < 3"), str(tmp_path / "c"))
    sinks.append_corpus(df.filter("seq = 3"), str(tmp_path / "c"))
    out = sinks.compact_corpus(spark, str(tmp_path / "c"), str(tmp_path / "d"))
    assert sorted((r.url, r.first_seen, r.title) for r in out.collect()) == [("https://e/a", 1, "A2"), ("https://e/b", 2, None)]
    again = corpus.compact(out.withColumnRenamed("first_seen", "seq"), "url", "seq")
    assert again.count() == 2
    sinks.write_index(out, str(tmp_path / "i"))
    assert [r.value for r in spark.read.text(str(tmp_path / "i")).collect()] == ["- [A2](https://e/a) · 3 characters", "- [https://e/b](https://e/b) · 2 characters"]
    sinks.write_pages(df, str(tmp_path / "p"), "seq")
    assert spark.read.parquet(str(tmp_path / "p")).select("file_name").orderBy("file_name").first()[0] == "001-e-a.md"
    sinks.write_csv(df.select("seq", F.array("title", "markdown").alias("l")), str(tmp_path / "csv"))
    assert {r.l for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {"A; x", "yy", "A2; zzz"}


def test_json_lines_and_url_lists(spark):
    lines = spark.createDataFrame([(1, '{"url": "u", "n": 1}'), (2, "{bad"), (3, '{"n": 2}'), (4, "[1]")], "line_no int, line string")
    assert [tuple(r) for r in responses.json_lines(lines, "url string, n int", "url").collect()] == [(1, "u", 1)]
    text = spark.createDataFrame([(0, "b.example a.example"), (1, " ftp://x a.example\tc.example ")], "line int, value string")
    got = [r.url for r in responses.url_list(text).orderBy("pos").collect()]
    assert got == ["https://b.example", "https://a.example", "https://c.example"]


def test_search_ranks_by_hand(spark):
    import math

    docs = [(1, "red red blue"), (2, "blue sky"), (3, "red"), (4, "green")]
    got = {r.doc_id: r.score for r in corpus.search(spark.createDataFrame(docs, "doc_id int, text string"), ["red", "Sky"]).collect()}
    n, avg = 4, 7 / 4
    want = {}
    for i, text in docs:
        w, s = text.split(), 0.0
        for term, df in (("red", 2), ("sky", 1)):
            tf = w.count(term)
            s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
        if s:
            want[i] = round(s, 6)
    assert got == pytest.approx(want)


def test_watch_across_batches(spark, tmp_path):
    src = tmp_path / "in"
    schema = "k string, t int, v string"
    rnd = random.Random(2)
    rows = [(rnd.choice("aab"), i, rnd.choice(["x", "y", None])) for i in range(60)]
    for b in range(3):
        spark.createDataFrame(rows[b * 20:(b + 1) * 20], schema).coalesce(1).write.mode("append").parquet(str(src))
        # Each run takes up what is new; a second run without new files changes nothing.
        for _ in range(2):
            stream = spark.readStream.schema(schema).parquet(str(src))
            jobs.watch(stream, str(tmp_path / "out"), ["k"], ["t"], F.floor(F.col("t") / 7), "v")
    got = sorted((r.k, r.t, r.old, r.new) for r in runs.read_rows(spark, str(tmp_path / "out")).collect())
    last, want = {}, []
    for k, t, v in rows:
        if k not in last or last[k] != v:
            want.append((k, t, last.get(k), v))
        last[k] = v
    assert got == sorted(want)


def test_watch_sets_late_rows_aside(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    for rows in ([("a", 10, "x"), ("b", 1, "y")], [("a", 5, "z"), ("a", 11, "x"), ("c", 0, None)], [("a", 12, "w"), ("b", 0, "q"), ("b", 2, "y")]):
        spark.createDataFrame(rows, "k string, t int, v string").coalesce(1).write.mode("append").parquet(str(src))
        jobs.watch(spark.readStream.schema("k string, t int, v string").parquet(str(src)), out, ["k"], ["t"], F.floor(F.col("t") / 7), "v")
    got = sorted((r.k, r.t, r.old, r.new) for r in runs.read_rows(spark, out).collect())
    assert got == [("a", 10, None, "x"), ("a", 12, "x", "w"), ("b", 1, None, "y"), ("c", 0, None, None)]
    assert sorted((r.k, r.t) for r in spark.read.parquet(f"{out}/late").collect()) == [("a", 5), ("b", 0)]


def test_last_value_answers_a_replayed_step_alike():
    """Steps in order, a late one, one that comes again, one settled long ago."""
    from weblode.streaming.state import LastValue

    class Kept:
        now = None

        def getValueState(self, *_):
            return self

        def exists(self):
            return self.now is not None

        def get(self):
            return self.now

        def update(self, x):
            self.now = x

    keeper = LastValue(["k"], None)
    keeper.init(Kept())
    step = lambda batch, at, value: {"batch": batch, "place": [at], "value": value}
    met = lambda *steps: [(r["batch"], r["place"], r["value"]) for r in keeper.handleInputRows(("a",), iter(steps), None)]
    assert met(step(0, 10, "x")) == [(0, None, None)]
    assert met(step(2, 5, "late"), step(1, 20, "y")) == [(1, [10], "x"), (2, [20], "y")]
    assert met(step(2, 5, "late")) == [(2, [20], "y")]
    assert met(step(0, 10, "x")) == []
    assert met(step(3, 21, None)) == [(3, [20], "y")]
    assert met(step(4, 22, "z")) == [(4, [21], None)]


def test_watch_order_must_be_comparable(spark):
    from weblode.streaming.state import places

    with pytest.raises(ValueError):
        places(spark.createDataFrame([("a",)], "t string"), ["t"])


def test_a_batch_touches_the_state_of_its_own_keys(spark, tmp_path):
    """A thousand keys are known; a batch of three keys updates three."""
    src, out = tmp_path / "in", str(tmp_path / "out")
    for rows in ([(f"k{i}", 1, "x") for i in range(1000)], [("k1", 2, "y"), ("k2", 2, "x"), ("new", 2, "x")]):
        spark.createDataFrame(rows, "k string, t int, v string").coalesce(1).write.mode("append").parquet(str(src))
        jobs.watch(spark.readStream.schema("k string, t int, v string").parquet(str(src)), out, ["k"], ["t"], F.floor(F.col("t") / 7), "v")
    assert spark.read.parquet(f"{out}/kept/run=1").count() == 3 and spark.read.parquet(f"{out}/steps/batch=1").count() == 3
    got = sorted((r.k, r.old, r.new) for r in runs.read_rows(spark, out).filter("batch = 1").collect())
    assert got == [("k1", "x", "y"), ("new", None, "x")]


def test_closed_sessions_come_once_and_late_rows_are_counted(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    stamp = lambda h: f"2024-01-01 {h:02d}:00:00"
    for hours in ([0, 1, 6], [7, 12], [2, 20], [23]):
        spark.createDataFrame([("h", stamp(h)) for h in hours], "host string, ts string").coalesce(1).write.mode("append").parquet(str(src))
        s = spark.readStream.schema("host string, ts string").parquet(str(src)).withColumn("ts", F.col("ts").cast("timestamp"))
        closed = jobs.bursts(s, "ts", "2 hours", "1 hour", ["host"])
        runs.run_available(closed.select("host", F.hour("w.start").alias("from"), "refused"), out, lambda df, n: runs.write_batch(df, out, n))
    got = sorted((r["from"], r.refused) for r in runs.read_rows(spark, out).collect())
    assert got == [(0, 2), (6, 2), (12, 1), (20, 1)][: len(got)] and len(got) >= 3
    assert sum(r.rows for r in runs.late_rows(spark, out).collect()) == 1
