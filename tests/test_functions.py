"""URL and text columns against Python's own functions."""

import html
import ipaddress
from urllib.parse import parse_qsl, urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from weblode.functions import headers, records, text, urls
from weblode.operators import audit

BASES = ["http://a.example/b/c/d;p?q", "https://a.example", "https://a.example/x/", "http://a.example/x/../y?k=1#f"]
REFS = [
    "g:h", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "", ".", "./", "..", "../", "../g", "../..", "../../g",
    "../../../g", "/./g", "/../g", "g.", ".g", "..g", "./../g", "./g/.", "g/./h", "g/../h", "a//b", "/x//y", "//other.example/p?q#f",
    "mailto:x@y", "https://z.example/a/../b",
]


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_resolve_is_urljoin(spark):
    pairs = [(b, r) for b in BASES for r in REFS]
    df = spark.createDataFrame(pairs, "b string, r string")
    for row in df.select("b", "r", urls.resolve("b", "r").alias("o")).collect():
        assert row.o == urljoin(row.b, row.r), (row.b, row.r)


def test_parts(spark):
    cases = ["https://User:pw@WWW.Example.com:8080/a/b?x=1&y#frag", "http://[2001:db8::1]:80/p", "https://h.example", "https://h.example?q=a?b#c#d"]
    assert column(spark, cases, urls.host) == [urlsplit(c).hostname for c in cases]
    assert column(spark, cases, urls.path) == [urlsplit(c).path for c in cases]
    assert column(spark, cases, urls.query) == [urlsplit(c).query for c in cases]
    assert column(spark, cases, urls.fragment) == [urlsplit(c).fragment for c in cases]
    assert column(spark, cases[:1], urls.site) == ["example.com"]


def test_normalize(spark):
    cases = ["example.org/a", " https://example.org ", "ftp://example.org", "http://[x", "https://", "http://[::1]/"]
    assert column(spark, cases, urls.normalize) == ["https://example.org/a", "https://example.org", None, None, None, "http://[::1]/"]


def test_slug(spark):
    cases = ["https://example.org/a b/c?x=1", "https://example.org/", "https://---/", "https://e.org/" + "x" * 200]
    assert column(spark, cases, urls.slug) == ["example.org-a-b-c", "example.org", "index", ("e.org-" + "x" * 200)[:80]]


def test_pairs(spark):
    cases = ["a=1&b=&c&d=x%20y+z&&e=%C3%A9", ""]
    got = column(spark, cases, urls.pairs)
    assert [[(p.name, p.value) for p in g] for g in got] == [parse_qsl(c, keep_blank_values=True) for c in cases]


def test_page_template(spark):
    assert column(spark, ["https://e.org/api?page=12&x=1"], urls.page_template) == ["https://e.org/api?page={}&x=1"]


def test_patterns_are_checked_before_the_job():
    with pytest.raises(ValueError):
        urls.check_pattern("*/blog/*", "match")


def test_unescape_is_html_unescape(spark):
    cases = [
        "a&amp;lt;b", "&copy; 2020 &middot;", "&copy 2020", "&#8364;&#x20AC;&#128;&#129;&#0;", "x & y &foo; &notit; &ampx", "&nbsp;|&apos;&quot;",
        "&eacute;&NotEqualTilde;", "&#xD800; &#99999999999999;", "plain", "", "&", "&;", "a&b&c", "&lt;b&gt;", "&#65", "&#x41g", "tail&amp",
    ]
    assert column(spark, cases, text.unescape) == [html.unescape(c) for c in cases]


def test_clean_and_strip(spark):
    cases = [" a\t\n b ", " x y　", "", "\x1cq\x1f"]
    assert column(spark, cases, text.clean) == [" ".join(c.split()) for c in cases]
    assert column(spark, cases, text.strip) == [c.strip() for c in cases]


def test_strip_html(spark):
    assert column(spark, ["<p>a &amp; b</p><br>c", None], text.strip_html) == ["a & b c", ""]


def test_numbers_and_dates(spark):
    assert column(spark, ["75", "3675", "5.9", "0"], lambda c: text.clock(c.cast("double"))) == ["1:15", "1:01:15", "0:05", "0:00"]
    assert column(spark, ["20240305", "2024"], text.day_text) == ["2024-03-05", "2024"]
    assert column(spark, ["1234567"], text.thousands) == ["1,234,567"]
    assert column(spark, ["es_ES.UTF-8", "C"], text.locale_label) == ["es-ES", None]
    assert column(spark, ["abcdef", "ab"], lambda c: text.cut(c, 3, " …")) == ["abc …", "ab"]


def test_markdown_tidying(spark):
    md = "![a](data:image/png;base64," + "B" * 90 + ")  \n\n\n\n[u](/up) [v](https://w.example/z) [t](#top) [q](b/c)\n"
    out = column(spark, [md], lambda c: text.tidy_markdown(c, F.lit("https://s.example/dir/page")))[0]
    assert "(data:…)" in out and "[u](https://s.example/up)" in out and "[v](https://w.example/z)" in out
    assert "[t](#top)" in out and "[q](https://s.example/dir/b/c)" in out and "\n\n\n" not in out and out.endswith(")\n")
    compact = column(spark, ["![i](https://e/b.png) words [name](https://e/(x)/y)"], text.compact_markdown)[0]
    assert compact == "words name\n"


def test_headers_and_cookies(spark):
    df = spark.createDataFrame([(["A: 1", "B:2", "A: 3", "bad"], "x=1; y=2=3; nothing; x=9")], "h array<string>, c string")
    row = df.select(headers.header_map("h"), headers.bad_headers("h"), headers.cookie_map("c")).first()
    assert row[0] == {"A": "3", "B": "2"} and row[1] == ["bad"] and row[2] == {"y": "2=3", "x": "9"}
    types = column(spark, ["application/pdf", "application/zip", "image/svg+xml", "application/x-very-long-name", "x/+"], headers.file_extension)
    assert types == ["pdf", "zip", "svg", "xverylon", "bin"]


def test_public_hosts_follow_ipaddress(spark):
    hosts = [
        "8.8.8.8", "10.1.2.3", "100.64.0.1", "100.128.0.1", "172.15.0.1", "172.20.1.1", "192.0.0.9", "192.0.0.8", "198.19.0.1", "198.20.0.1", "224.0.0.1",
        "255.255.255.255", "0.1.2.3", "169.254.1.1", "203.0.113.9", "::1", "::", "2606:4700::1111", "fe80::1", "fc00::1", "2001:db8::1", "2001:20::1",
        "::ffff:127.0.0.1", "::ffff:8.8.8.8", "::ffff:7f00:1", "2002::1", "64:ff9b:1::1", "3fff::1", "2001:3::1", "1:2:3:4:5:6:7:8",
    ]

    def expected(h):
        ip = ipaddress.ip_address(h)
        return (getattr(ip, "ipv4_mapped", None) or ip).is_global

    assert column(spark, hosts, audit.is_public_host) == [expected(h) for h in hosts]
    names = ["localhost", "localhost.", "host", "a.example", "nas.x.ts.net", "wiki.corp", "r.home.arpa", "", "homely.example"]
    assert column(spark, names, audit.is_public_host) == [False, False, False, True, False, False, False, False, True]


def test_secret_parameters(spark):
    bad = ["X-Amz-Signature=a", "api-key=1", "auth_token=1", "client_secret=1", "sessionid=1", "code=1", "jwt=1", "sid=", "a.key=1"]
    fine = ["keywords=a&location=b", "author=ana&page=2", "design=1&postcode=28001"]
    assert all(column(spark, ["https://e.example/?" + q for q in bad], audit.has_secret_params))
    assert column(spark, ["https://e.example/#access_token=1"], audit.has_secret_params) == [True]
    assert not any(column(spark, ["https://e.example/?" + q for q in fine], audit.has_secret_params))


def test_sharing(spark):
    got = column(spark, ["https://e.example/a?id=3", "https://u:p@e.example/", "http://localhost:3000/"], audit.sharing_problems)
    assert got == [[], ["carries a user name"], ["host is not public"]]
    assert column(spark, ["https://e.example/"], lambda c: audit.sharing_problems(c, F.lit(True))) == [["credentials are in play"]]


def test_credentials_stay_on_their_site(spark):
    cases = ["https://www.e.example/x", "https://api.e.example/x", "https://e.example.evil.test/x", "https://cdn.other.example/x"]
    assert column(spark, cases, lambda c: audit.may_receive_credentials(c, F.lit("e.example"))) == [True, True, False, False]


def test_routes(spark):
    cases = {
        "https://www.youtube.com/watch?v=abc": "video", "https://youtu.be/abc": "video", "https://www.youtube.com/@someone": None,
        "https://x.com/a/status/20": "tweet", "https://twitter.com/a/statuses/20?s=1": "tweet", "https://x.com/a": None,
        "https://www.reddit.com/r/p/comments/abc/t/": None, "https://old.reddit.com/r/p/new/": "reddit", "https://www.reddit.com/r/p/s/Ab1": None,
        "https://github.com/o/r": "github", "https://github.com/o/r/issues/1": None, "https://github.com/search/x": None, "https://e.example/": None,
    }
    assert column(spark, list(cases), audit.route) == list(cases.values())


def test_lists_and_fallbacks(spark):
    assert column(spark, ['["a","b"]', "a, b", "[]"], records.list_or_text) == ["a, b", "a, b", ""]
    row = spark.range(1).select(records.first_present(F.lit(""), F.lit(None).cast("string"), F.lit("x"))).first()
    assert row[0] == "x"


def test_assembled_leaves_out_empty_parts(spark):
    from weblode.functions import records

    df = spark.createDataFrame([([("a\"b", "1"), ("c", "{}")], ["1", '{"x":[]}'], "[]", None)], "o array<struct<key:string,body:string>>, l array<string>, e string, n string")
    doc = records.assembled(o=records.json_object(F.col("o")), l=records.json_list(F.col("l")), e=F.col("e"), n=F.col("n"), s=F.lit('""'), m=F.lit("{}"), z=F.lit("0"))
    import json

    assert json.loads(df.select(doc).first()[0]) == {"o": {'a"b': 1, "c": {}}, "l": [1, {"x": []}], "z": 0}
    assert df.select(records.assembled(n=F.col("n"))).first()[0] == "{}"
