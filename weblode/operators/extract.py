"""Links, metadata, embedded data, main content, Markdown and outlines of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weblode.functions.text import clean, drop_zero_width, let, squeeze_markdown, strip
from weblode.functions.urls import check_pattern, drop_fragment, host, host_is, resolve, site
from weblode.functions.records import assembled, json_list, json_object
from weblode.operators import dom
from weblode.operators.rows import settle
from weblode.operators.select import Step, select, select_any


def link_array(base: str = "url", same_site: bool = False, match: str | None = None, limit: int = 0, within=None) -> Column:
    """Distinct http(s) links of a page as an array of (pos, text, url), in page order.

    The first occurrence of a URL counts.  Sorting by URL puts repeats next to
    each other, so the page is deduplicated in its own row, in n log n.
    """
    anchors = Step(tag="a", attrs=(("href", "has", None),))
    paths = [(anchors,)] if within is None else [tuple(p) + (anchors,) for p in within]

    def describe(n: Column) -> Column:
        url = drop_fragment(resolve(F.col(base), strip(dom.attribute(n, "href"))))
        return F.struct(url.alias("url"), n["pos"].alias("pos"))

    def wanted(x: Column) -> Column:
        test = x["url"].rlike("^https?://")
        if same_site:
            test = test & host_is(host(x["url"]), site(base))
        if match:
            test = test & x["url"].rlike(check_pattern(match, "match"))
        return test

    def first_ones(ordered: Column) -> Column:
        fresh = F.filter(ordered, lambda x, i: (i == 0) | (F.get(ordered, i - 1)["url"] != x["url"]))
        return F.array_sort(F.transform(fresh, lambda x: F.struct(x["pos"].alias("pos"), x["url"].alias("url"))))

    kept = let(F.array_sort(F.filter(F.transform(select_any("nodes", paths), describe), wanted)), first_ones)
    if limit:
        kept = F.slice(kept, 1, limit)
    nodes = F.col("nodes")
    return F.transform(
        kept,
        lambda x: F.struct(
            x["pos"].alias("pos"), F.left(clean(dom.subtree_text(nodes, F.get(nodes, x["pos"]))), F.lit(120)).alias("text"), x["url"].alias("url")
        ),
    )


def links(doms: DataFrame, keep=("page_id",), base: str = "url", **options) -> DataFrame:
    """(keep, pos, text, url, same_site): the links of ``link_array`` as rows, without a shuffle."""
    rows = doms.select(*keep, site(base).alias("_site"), F.inline(link_array(base, **options)))
    return rows.withColumn("same_site", host_is(host("url"), F.col("_site"))).drop("_site")


def _first_attr(paths, name: str) -> Column:
    got = F.transform(select_any("nodes", paths), lambda n: dom.attribute(n, name))
    return F.nullif(clean(F.get(F.filter(got, lambda v: v.isNotNull()), F.lit(0))), F.lit(""))


def jsonld_texts() -> Column:
    """Bodies of the ld+json scripts that parse."""
    found = select("nodes", [Step(tag="script", attrs=(("type", "=", "application/ld+json"),))])
    bodies = F.transform(found, dom.script_body)
    return F.filter(bodies, lambda b: F.try_parse_json(b).isNotNull())


def metadata(doms: DataFrame, keep=("page_id", "url", "status")) -> DataFrame:
    """Title, description, canonical link, language, headings, social tags, feeds, JSON-LD."""
    nodes = F.col("nodes")
    named = lambda key, value: Step(tag="meta", attrs=((key, "=", value),))
    social_nodes = select_any(
        "nodes",
        [
            (Step(tag="meta", attrs=(("property", "^=", "og:"),)),),
            (Step(tag="meta", attrs=(("name", "^=", "twitter:"),)),),
            (Step(tag="meta", attrs=(("property", "^=", "article:"),)),),
        ],
    )
    social = F.transform(
        social_nodes,
        lambda n: F.struct(
            F.coalesce(F.nullif(dom.attribute(n, "property"), F.lit("")), dom.attribute(n, "name")).alias("key"),
            dom.attribute(n, "content").alias("value"),
        ),
    )
    # A repeated key keeps its last value.
    last = lambda all_: F.filter(
        all_,
        lambda e, i: ~F.exists(F.slice(all_, i + 2, F.greatest(F.size(all_) - i - 1, F.lit(0))), lambda o: o["key"] == e["key"]),
    )
    feed = lambda kind: F.transform(
        select("nodes", [Step(tag="link", attrs=(("rel", "=", "alternate"), ("type", "*=", kind), ("href", "has", None)))]),
        lambda n: resolve(F.col("url"), dom.attribute(n, "href")),
    )
    heads = F.transform(
        F.slice(select("nodes", [Step(tag="h1")]), 1, 5), lambda n: clean(dom.subtree_text(nodes, n))
    )
    return doms.select(
        *keep,
        F.nullif(dom.page_title(), F.lit("")).alias("title"),
        _first_attr([(named("name", "description"),)], "content").alias("description"),
        _first_attr([(Step(tag="link", attrs=(("rel", "=", "canonical"),)),)], "href").alias("canonical"),
        _first_attr([(Step(tag="html"),)], "lang").alias("lang"),
        heads.alias("h1"),
        let(social, lambda s: F.map_from_entries(last(F.filter(s, lambda e: e["key"].isNotNull())))).alias("social"),
        F.concat(feed("rss"), feed("atom")).alias("feeds"),
        jsonld_texts().alias("jsonld"),
    )


def _last_of_key(pairs: Column) -> Column:
    """Of (key, body) structs with equal keys the last one; a page has few, so each looks at those after it."""
    return let(pairs, lambda all_: F.filter(
        all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.greatest(F.size(all_) - i - 1, F.lit(0))), lambda o: o["key"] == e["key"])))


def json_script_array() -> Column:
    """Embedded JSON scripts as (key, body); of equal keys the last that parses stays."""
    found = select_any(
        "nodes",
        [
            (Step(tag="script", attrs=(("type", "=", "application/json"),)),),
            (Step(tag="script", id="__NEXT_DATA__"),),
            (Step(tag="script", id="__NUXT_DATA__"),),
        ],
    )
    named = F.transform(
        found,
        lambda n, i: F.struct(
            F.coalesce(
                F.nullif(dom.attribute(n, "id"), F.lit("")),
                F.nullif(dom.attribute(n, "data-target"), F.lit("")),
                F.concat(F.lit("json_"), i.cast("string")),
            ).alias("key"),
            dom.script_body(n).alias("body"),
        ),
    )
    return _last_of_key(F.filter(named, lambda x: F.try_parse_json(x["body"]).isNotNull()))


def json_scripts(doms: DataFrame, keep=("page_id",)) -> DataFrame:
    """The scripts of ``json_script_array`` as rows, without a shuffle."""
    return doms.select(*keep, F.inline(json_script_array()))


# Fixed value: how a page names the state it assigns for its scripts.
STATE_NAME = r"(?:window\.)?(__[A-Z0-9_]{4,}__)\s*=\s*"


def state_array() -> Column:
    """``window.__NAME__ = {...}`` values as (key, body); the last assignment stays.

    The value is the shortest prefix that closes on a bracket and parses;
    what follows it is ignored.
    """
    scripts = F.filter("nodes", lambda n: (n["kind"] == "raw") & (n["tag"] == "script") & dom.attribute(n, "src").isNull())
    heads = lambda body, part: F.regexp_extract_all(body, F.lit(STATE_NAME + r"[{\[]"), F.lit(part))

    def starts(body: Column) -> Column:
        """Where each value begins: names are found one after the other."""
        return F.aggregate(
            heads(body, 0),
            F.struct(F.lit(1).alias("from"), F.array().cast("array<int>").alias("at")),
            lambda acc, h: let(
                F.call_function("locate", h, body, acc["from"]),
                lambda p: F.struct((p + F.length(h)).alias("from"), F.array_append(acc["at"], p + F.length(h) - 1).alias("at")),
            ),
            lambda acc: acc["at"],
        )

    def values_of(body: Column) -> Column:
        spots = F.arrays_zip(heads(body, 1).alias("key"), starts(body).alias("at"))
        return F.transform(spots, lambda s: F.struct(s["key"].alias("key"), first_json(F.substr(body, s["at"])).alias("body")))

    bodies = F.filter(F.transform(scripts, dom.script_body), lambda b: b.rlike(STATE_NAME + r"[{\[]"))
    return _last_of_key(F.filter(F.flatten(F.transform(bodies, values_of)), lambda x: x["body"].isNotNull()))


def state_assignments(doms: DataFrame, keep=("page_id",)) -> DataFrame:
    """The values of ``state_array`` as rows, without a shuffle."""
    return doms.select(*keep, F.inline(state_array()))


def data() -> Column:
    """All JSON a page embeds as one JSON text, its empty parts left out: ``jsonld``, ``json_scripts`` and ``state``."""
    return assembled(jsonld=json_list(jsonld_texts()), json_scripts=json_object(json_script_array()), state=json_object(state_array()))


_HEAD = 1 << 16


def first_json(text) -> Column:
    """The JSON object or array at the start of a text, whatever follows.

    Depth is followed over structural characters only (strings are blanked to
    equal length first), so the one closing place is found in a single pass
    and parsed once.
    """
    text = F.col(text) if isinstance(text, str) else text
    # Pieces: a string, a bracket, or a run of anything else.
    piece = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\]]|[^"{}\[\]]++|"'

    def fold(part: Column) -> Column:
        return F.aggregate(
            F.regexp_extract_all(part, F.lit(piece), F.lit(0)),
            F.struct(F.lit(0).alias("depth"), F.lit(0).alias("len"), F.lit(False).alias("done")),
            lambda a, p: F.when(a["done"], a).otherwise(
                let(
                    a["depth"] + F.when(p.isin("{", "["), 1).when(p.isin("}", "]"), -1).otherwise(0),
                    lambda d: F.struct(
                        d.alias("depth"), (a["len"] + F.length(p)).alias("len"), (d <= 0).alias("done")
                    ),
                )
            ),
            lambda a: F.when(a["done"], F.left(text, a["len"])),
        )

    parsed = lambda part: let(fold(part), lambda v: F.when(F.try_parse_json(v).isNotNull(), v))
    # Most values end soon: what follows them is not cut up.  A value that runs
    # on past the head (or whose head ends in a string) parses only as a whole.
    return F.coalesce(parsed(F.left(text, F.lit(_HEAD))), F.when(F.length(text) > _HEAD, parsed(text)))


# Where main content is looked for, in this order.
FOCUS_RULES = (
    ("main", Step(tag="main")),
    ("[role=main]", Step(attrs=(("role", "=", "main"),))),
    ("article", Step(tag="article")),
    ("#main-content", Step(id="main-content")),
    ("#main", Step(id="main")),
    ("#content", Step(id="content")),
    (".main-content", Step(classes=("main-content",))),
    (".post-content", Step(classes=("post-content",))),
    (".entry-content", Step(classes=("entry-content",))),
    (".article-body", Step(classes=("article-body",))),
)
FOCUS_MIN_TEXT, FOCUS_SHARE = 400, 0.5


def focus() -> Column:
    """(rule, pos) of the main container, or null: the first rule with exactly
    one match that keeps at least half of a text of 400 characters or more."""
    nodes = F.col("nodes")

    def choose(total: Column) -> Column:
        options = []
        for name, step in FOCUS_RULES:
            found = select(nodes, [step])
            kept = let(
                found,
                lambda f: F.when(
                    (F.size(f) == 1)
                    & (F.length(dom.subtree_text(nodes, F.get(f, F.lit(0)))) >= total * FOCUS_SHARE),
                    F.struct(F.lit(name).alias("rule"), F.get(f, F.lit(0))["pos"].alias("pos")),
                ),
            )
            options.append(kept)
        return F.when(total >= FOCUS_MIN_TEXT, F.coalesce(*options))

    return let(F.length(dom.page_text()), choose)


def with_focus(doms: DataFrame) -> DataFrame:
    """Adds ``focus`` (rule, pos) and ``text_len``."""
    return settle(doms, ["*"], text_len=F.length(dom.page_text()), focus=focus())


_HEADINGS = {f"h{i}": "#" * i for i in range(1, 7)}
_PARAGRAPHS = (
    "p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "figure", "figcaption", "form",
    "fieldset", "address", "details", "summary", "dl", "dt", "dd", "ul", "ol", "table", "blockquote", "body",
)
_EMPHASIS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "del": "~~", "s": "~~"}
_NOT_SHOWN = ("head", "title", "meta", "link")


def _pieces(nodes: Column, lo: Column, hi: Column, base: Column) -> Column:
    """Markdown pieces of ``[lo, hi)`` as (pos, rank, order, text), unsorted."""
    span = F.filter(
        F.slice(nodes, lo + 1, hi - lo),
        lambda n: ~n["hidden"] & (dom.is_element(n) | (n["kind"] == "text")) & ~n["tag"].isin(*_NOT_SHOWN),
    )
    def is_tag(n: Column, *tags: str) -> Column:
        return n["tag"].isin(*tags)

    def opening(n: Column) -> Column:
        out = F.when(n["kind"] == "text", F.regexp_replace(drop_zero_width(n["text"]), r"[\s\x{a0}]+", " "))
        for tag, mark in _HEADINGS.items():
            out = out.when(is_tag(n, tag), F.lit(f"\n\n{mark} "))
        for tag, mark in _EMPHASIS.items():
            out = out.when(is_tag(n, tag), F.lit(mark))
        href = let(
            F.coalesce(strip(dom.attribute(n, "href")), F.lit("")),
            lambda h: F.when((h == "") | h.startswith("#"), h).otherwise(resolve(base, h)),
        )
        src = let(
            F.coalesce(strip(dom.attribute(n, "src")), F.lit("")),
            lambda s: F.when(
                s.rlike(r"^data:[^)\s]{40,}"), F.lit("data:…")
            ).otherwise(F.when(s == "", s).otherwise(resolve(base, s))),
        )
        out = (
            out.when(is_tag(n, "br"), F.lit("\n"))
            .when(is_tag(n, "hr"), F.lit("\n\n---\n\n"))
            .when(is_tag(n, "li"), F.lit("\n- "))
            .when(is_tag(n, "tr"), F.lit("\n| "))
            .when(is_tag(n, "pre"), F.lit("\n\n```\n"))
            .when(is_tag(n, "a"), F.lit("["))
            .when(is_tag(n, "img"), F.concat(F.lit("!["), F.coalesce(dom.attribute(n, "alt"), F.lit("")), F.lit("]("), src, F.lit(")")))
            .when(is_tag(n, *_PARAGRAPHS), F.lit("\n\n"))
            .otherwise(F.lit(""))
        )
        closing = F.when(is_tag(n, *_HEADINGS), F.lit("\n\n"))
        for tag, mark in _EMPHASIS.items():
            closing = closing.when(is_tag(n, tag), F.lit(mark))
        closing = (
            closing.when(is_tag(n, "a"), F.concat(F.lit("]("), href, F.lit(")")))
            .when(is_tag(n, "td", "th"), F.lit(" | "))
            .when(is_tag(n, "pre"), F.lit("\n```\n\n"))
            .when(is_tag(n, *_PARAGRAPHS), F.lit("\n\n"))
            .otherwise(F.lit(""))
        )
        # Ends come before whatever starts at the same place, inner ones first.
        return F.array(
            F.struct(n["pos"].alias("pos"), F.lit(1).alias("rank"), F.lit(0).alias("order"), out.alias("text")),
            F.struct(
                F.least(n["end"], hi).alias("pos"), F.lit(0).alias("rank"), (-n["pos"]).alias("order"),
                F.when(n["kind"] == "open", closing).otherwise(F.lit("")).alias("text"),
            ),
        )

    return F.filter(F.flatten(F.transform(span, opening)), lambda p: p["text"] != "")


def markdown(pos: Column | None = None, base="url") -> Column:
    """Markdown of one element, or of the whole page (scripts and hidden parts left out)."""
    nodes = F.col("nodes")
    base = F.col(base) if isinstance(base, str) else base
    start = F.lit(0) if pos is None else F.coalesce(pos, F.lit(0))
    end = F.size(nodes) if pos is None else F.coalesce(F.get(nodes, pos)["end"], F.size(nodes))

    def build(span: Column) -> Column:
        ordered = F.array_sort(_pieces(nodes, span["lo"], span["hi"], base))
        return F.array_join(F.transform(ordered, lambda p: p["text"]), "")

    text = let(F.struct(start.alias("lo"), end.alias("hi")), build)
    # Blanks next to a line break come from the markup, not from the author.
    return squeeze_markdown(F.regexp_replace(text, r"\n[ \t]+", "\n"))


def visible_text(pos: Column | None = None) -> Column:
    """Text of one element or the page without hidden parts, one run per line."""
    nodes = F.col("nodes")
    shown = F.filter(nodes, lambda n: (n["kind"] == "text") & ~n["hidden"])
    if pos is not None:
        node = F.get(nodes, pos)
        inner = F.filter(dom.inside(nodes, node), lambda n: (n["kind"] == "text") & ~n["hidden"])
        shown = F.when(pos.isNotNull(), inner).otherwise(shown)
    texts = F.transform(shown, lambda n: strip(drop_zero_width(n["text"])))
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n")


def documents(doms: DataFrame, keep=("page_id",), full_page: bool = False, text: bool = False) -> DataFrame:
    """(url, status, title, body, focus rule) per page; ``reason`` when nothing is left after cleaning."""
    d = doms if full_page else with_focus(doms)
    pos = None if full_page else F.col("focus.pos")
    body = visible_text(pos) if text else markdown(pos)
    rule = F.lit(None).cast("string") if full_page else F.col("focus.rule")
    out = settle(d, [*keep, "url", "status"], title=dom.page_title(), focus=rule, markdown=body)
    return out.withColumn("reason", F.when(strip("markdown") == "", F.lit("no visible text is left after cleaning")))


# Fixed value: elements an outline leaves out besides raw-text ones.
_OUTLINE_SKIPS = ("script", "style", "noscript", "svg", "template", "iframe", "link", "meta", "br", "hr")


def signature(n: Column) -> Column:
    """``tag#id.first.three.classes``"""
    ident = let(dom.attribute(n, "id"), lambda i: F.when(F.coalesce(i, F.lit("")) != "", F.concat(F.lit("#"), i)).otherwise(F.lit("")))
    words = F.filter(F.split(F.coalesce(dom.attribute(n, "class"), F.lit("")), r"\s+"), lambda w: w != "")
    return F.concat(n["tag"], ident, F.array_join(F.transform(F.slice(words, 1, 3), lambda c: F.concat(F.lit("."), c)), ""))


def outline(doms: DataFrame, keep=("page_id",), max_depth: int = 6, max_lines: int = 400) -> DataFrame:
    """Skeleton lines (line, depth, text): siblings of equal signature are
    counted and only the first of each group is opened."""
    keys = list(keep)

    def brief(n: Column) -> Column:
        text = clean(dom.subtree_text("nodes", n))
        has_child = F.exists(dom.inside("nodes", n), lambda c: dom.is_element(c) & (c["parent"] == n["pos"]))
        return F.struct(
            n["pos"].alias("pos"), n["end"].alias("end"), n["parent"].alias("parent"), n["depth"].alias("depth"),
            signature(n).alias("sig"), F.length(text).alias("len"),
            F.when(~has_child & (text != ""), F.left(text, F.lit(50))).alias("sample"),
        )

    def shown(root: Column) -> Column:
        below = F.filter(
            dom.inside("nodes", root),
            lambda n: dom.is_element(n) & ~n["tag"].isin(*_OUTLINE_SKIPS) & (n["depth"] <= root["depth"] + max_depth),
        )
        return F.transform(
            F.concat(F.array(root), below),
            lambda n: F.struct(brief(n).alias("n"), root["pos"].alias("root_pos"), root["depth"].alias("root_depth")),
        )

    body = F.slice(F.filter("nodes", lambda n: (n["kind"] == "open") & (n["tag"] == "body")), 1, 1)
    rows = doms.select(*keys, F.inline(F.flatten(F.transform(body, shown)))).select(*keys, "n.*", "root_pos", "root_depth")
    # One exchange by page serves every window below.
    rows = rows.repartition(*keys)
    group = Window.partitionBy(*keys, "parent", "sig")
    rows = rows.withColumn("times", F.count("*").over(group)).withColumn("nth", F.row_number().over(group.orderBy("pos")))
    # Everything inside a repeated sibling is covered by it and not shown.
    order = Window.partitionBy(*keys).orderBy("pos")
    rows = rows.withColumn("covered", F.max(F.when(F.col("nth") > 1, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.filter(F.col("covered").isNull() | (F.col("covered") <= F.col("pos")))
    rows = rows.withColumn("line", F.row_number().over(order))
    level = F.col("depth") - F.col("root_depth")
    text = F.when(level == 0, F.col("sig")).otherwise(
        F.concat(
            F.repeat(F.lit("  "), level), "sig",
            F.when(F.col("times") > 1, F.concat(F.lit(" ×"), F.col("times").cast("string"))).otherwise(F.lit("")),
            F.lit(" ("), F.col("len").cast("string"), F.lit(")"),
            F.coalesce(F.concat(F.lit(" “"), "sample", F.lit("”")), F.lit("")),
        )
    )
    lines = rows.select(*keys, "line", level.alias("depth"), text.alias("text"))
    # A level is not entered once the outline has grown to the limit.  A
    # line's parent is the last line one level up: every line is also put one
    # level down, where the lines below it find it.
    both = lines.withColumn("as_parent", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn(
        "at", F.col("depth") + F.col("as_parent").cast("int"))
    above = Window.partitionBy(*keys, "at").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("parent_line", F.last(F.when(F.col("as_parent"), F.col("line")), True).over(above)).filter(~F.col("as_parent"))
    return both.filter((F.col("depth") == 0) | (F.col("parent_line") < max_lines)).select(*keys, "line", "depth", "text")


def find_by_text(doms: DataFrame, text: Column, keep=("page_id",)) -> DataFrame:
    """(keep, pos, tag, text): elements whose own text, cleaned, equals a value of the page."""
    nodes = F.col("nodes")

    def hits(wanted: Column) -> Column:
        same = lambda n: (n["kind"] == "open") & (clean(F.array_join(dom.own_texts(nodes, n), " ")) == wanted)
        return F.transform(F.filter(nodes, same), lambda n: F.struct(n["pos"].alias("pos"), n["tag"].alias("tag"), wanted.alias("text")))

    return doms.select(*keep, F.inline(F.when(text != "", let(text, hits))))


def find_similar(doms: DataFrame, like: Column, keep=("page_id",)) -> DataFrame:
    """Elements built like the given ones: same depth, tag, parent tag and attribute names."""
    nodes = F.col("nodes")

    def shape(n: Column) -> Column:
        names = F.coalesce(F.transform(n["attrs"], lambda a: a["name"]), F.array().cast("array<string>"))
        return F.struct(
            n["depth"].alias("depth"), n["tag"].alias("tag"), F.coalesce(F.get(nodes, n["parent"])["tag"], F.lit("")).alias("parent_tag"),
            F.array_sort(F.array_distinct(names)).alias("names"),
        )

    def alike(wanted: Column) -> Column:
        shaped = F.transform(F.filter(nodes, dom.is_element), lambda n: F.struct(n["pos"].alias("pos"), shape(n).alias("s")))
        return F.filter(shaped, lambda x: F.array_contains(wanted, x["s"]))

    rows = doms.select(*keep, F.inline(let(F.array_distinct(F.transform(like, shape)), alike)))
    return rows.select(*keep, "pos", "s.tag", "s.depth", "s.parent_tag")
