"""Platform records: stored JSON, XML and captions flattened to tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from weblode.functions.records import best_media, expanded_text, first_present, list_or_text
from weblode.functions.text import clean, clock, cut, day_text, let, strip, strip_html, thousands, unescape
from weblode.functions.urls import resolve
from weblode.operators import dom, extract, ordered
from weblode.operators.rows import settle
from weblode.operators.select import Step, matches, select

# ---- feeds -------------------------------------------------------------

FEED_ROOT = r"<(rss|feed|rdf:RDF)[\s>]"
_RSS = "struct<title:string,item:array<struct<title:string,link:string,pubDate:string,`dc:date`:string,description:string,`content:encoded`:string>>>"
_ATOM = (
    "title string, entry array<struct<title:string,link:array<struct<_href:string,_rel:string>>,published:string,"
    "updated:string,content:string,summary:string>>"
)
_RDF = "channel struct<title:string>, item array<struct<title:string,link:string,`dc:date`:string,description:string,`content:encoded`:string>>"


def feed_items(feeds: DataFrame, keys: Sequence[str], body: str = "body", top: int = 15, full: bool = False) -> DataFrame:
    """(keys, feed_title, n, title, link, date, text) for RSS, Atom and RDF bodies; the first ``top`` entries of each."""
    dialect = F.regexp_extract(F.left(F.col(body), F.lit(3000)), FEED_ROOT, 1)
    d = feeds.withColumn("_d", dialect).filter(F.col("_d") != "")
    # A bare ampersand or a name only HTML knows makes the whole feed unreadable: such bodies get a second reading.
    mended = F.regexp_replace(F.col(body), r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#[xX][0-9a-fA-F]+);)", "&amp;")

    def parsed(kind: str, schema: str, part: str) -> Column:
        once = let(F.from_xml(F.col(body), schema), lambda x: F.when(part_of(x, part).isNotNull(), x))
        return F.when(F.col("_d") == kind, F.coalesce(once, F.from_xml(mended, schema)))

    part_of = lambda x, names: part_of(x[names.split(".", 1)[0]], names.split(".", 1)[1]) if "." in names else x[names]
    rss, atom, rdf = parsed("rss", f"channel {_RSS}", "channel.item"), parsed("feed", _ATOM, "entry"), parsed("rdf:RDF", _RDF, "item")

    def item(title, link, date, text) -> Column:
        return F.struct(title.alias("title"), link.alias("link"), date.alias("date"), text.alias("text"))

    plain = lambda e, when: item(
        e["title"], e["link"], when, first_present(e["content:encoded"], e["description"])
    )
    d = d.withColumn("_rss", rss).withColumn("_atom", atom).withColumn("_rdf", rdf)
    entries = F.coalesce(
        F.transform("_rss.channel.item", lambda e: plain(e, first_present(e["pubDate"], e["dc:date"]))),
        F.transform(
            "_atom.entry",
            lambda e: item(
                e["title"],
                F.coalesce(
                    F.get(F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"],
                    F.get(e["link"], F.lit(0))["_href"],
                ),
                first_present(e["published"], e["updated"]), first_present(e["content"], e["summary"]),
            ),
        ),
        F.transform("_rdf.item", lambda e: plain(e, e["dc:date"])),
    )
    shown = F.slice(entries, 1, top) if top else entries
    rows = d.select(*keys, F.coalesce("_rss.channel.title", "_atom.title", "_rdf.channel.title").alias("feed_title"),
                    F.posexplode(shown).alias("n", "e"))
    text = strip_html("e.text")
    return rows.select(
        *keys, "feed_title", (F.col("n") + 1).alias("n"),
        F.coalesce(F.nullif(clean("e.title"), F.lit("")), F.lit("(untitled)")).alias("title"),
        F.coalesce("e.link", F.lit("")).alias("link"), F.coalesce("e.date", F.lit("")).alias("date"),
        (text if full else F.left(text, F.lit(300))).alias("text"),
    )


def feed_problems(feeds: DataFrame, keys: Sequence[str], body: str = "body") -> DataFrame:
    """(keys, reason) of bodies that give no feed items."""
    found = feed_items(feeds, keys, body, top=1).select(*keys, F.lit(True).alias("_some"))
    is_feed = F.left(F.col(body), F.lit(3000)).rlike(FEED_ROOT)
    rest = feeds.join(found, list(keys), "left_anti")
    return rest.select(*keys, F.when(is_feed, F.lit("no entry of the feed can be read")).otherwise(F.lit("not a feed")).alias("reason"))


def discovered_feed(html: Column, base: Column) -> Column:
    """(feed, reason): the first feed a page advertises, absolute."""
    tag = F.regexp_extract(html, r"""(?i)<link[^>]+type=["']application/(?:rss|atom)\+xml["'][^>]*>""", 0)
    href = F.regexp_extract(tag, r"""href=["']([^"']+)""", 1)
    return F.when(href != "", F.struct(resolve(base, href).alias("feed"), F.lit(None).cast("string").alias("reason"))).otherwise(
        F.struct(F.lit(None).cast("string").alias("feed"), F.lit("no feed is advertised").alias("reason"))
    )


def listing_feed_url(u: Column) -> Column:
    """A community listing's address rewritten to its feed."""
    from weblode.functions import urls

    q = urls.query(u)
    return F.concat(
        urls.scheme(u), F.lit("://www.reddit.com"), F.regexp_replace(urls.path(u), r"/+$", ""), F.lit("/.rss"),
        F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")),
    )


# ---- threads -----------------------------------------------------------


def threads(doms: DataFrame, keep: Sequence[str] = ("url",)) -> DataFrame:
    """One row per thread page: post fields, body and the array of comments with text.

    Pages without a post element are not threads and give no row.
    """
    nodes = F.col("nodes")
    at = dom.attribute
    post = F.get(select(nodes, [Step(tag="shreddit-post")]), F.lit(0))

    def comment(c: Column) -> Column:
        own = let(
            F.concat(F.coalesce(at(c, "thingid"), F.lit("")), F.lit("-comment-rtjson-content")),
            lambda wanted: F.get(F.filter(dom.inside(nodes, c), lambda n: dom.is_element(n) & (at(n, "id") == wanted)), F.lit(0)),
        )
        text = let(own, lambda n: F.coalesce(clean(dom.subtree_text(nodes, n)), F.lit("")))
        return F.struct(
            at(c, "author").alias("author"), F.coalesce(F.nullif(at(c, "depth"), F.lit("")).try_cast("int"), F.lit(0)).alias("depth"),
            at(c, "score").alias("score"), F.left(F.coalesce(at(c, "created"), F.lit("")), F.lit(10)).alias("created"),
            text.alias("text"),
            resolve(F.lit("https://www.reddit.com"), F.coalesce(at(c, "permalink"), F.lit(""))).alias("url"),
        )

    comments = F.filter(F.transform(select(nodes, [Step(tag="shreddit-comment")]), comment), lambda c: c["text"] != "")
    body = F.get(
        F.filter(
            dom.inside(nodes, F.col("_post")), lambda n: dom.is_element(n) & at(n, "id").endswith("-post-rtjson-content")
        ),
        F.lit(0),
    )["pos"]
    d = settle(doms, [*keep, "nodes"] if "url" in keep else [*keep, "url", "nodes"], _post=post).filter(F.col("_post").isNotNull())
    d = settle(d, ["*"], _body=body, comments=comments)
    p = F.col("_post")
    return d.select(
        *keep, at(p, "post-title").alias("title"), at(p, "subreddit-prefixed-name").alias("community"), at(p, "author").alias("author"),
        at(p, "created-timestamp").alias("created"), at(p, "score").alias("score"),
        at(p, "comment-count").try_cast("int").alias("announced"),
        F.when(at(p, "post-type") == "link", at(p, "content-href")).alias("link"),
        F.when(F.col("_body").isNotNull(), strip(extract.markdown(F.col("_body")))).otherwise(F.lit("")).alias("body"),
        "comments",
    )


def thread_text(url: str = "url") -> Column:
    """A thread row as one indented Markdown document."""
    lines = F.transform(
        "comments",
        lambda c: F.concat(F.repeat(F.lit("  "), c["depth"]), F.lit("- **u/"), c["author"], F.lit("** ("), c["score"], F.lit(" pts): "), c["text"]),
    )
    head = F.concat(
        F.lit("# "), F.coalesce("title", F.lit("(untitled)")), F.lit("\n"), F.coalesce("community", F.lit("")), F.lit(" · u/"),
        F.coalesce("author", F.lit("?")), F.lit(" · "), F.left(F.coalesce("created", F.lit("")), F.lit(10)), F.lit(" · "),
        F.coalesce("score", F.lit("?")), F.lit(" points · "), F.coalesce(F.col("announced").cast("string"), F.lit("?")), F.lit(" comments\nURL: "), F.col(url),
    )
    return F.concat(
        head,
        F.coalesce(F.concat(F.lit("\nLink: "), F.nullif("link", F.lit(""))), F.lit("")),
        F.when(F.col("body") != "", F.concat(F.lit("\n\n"), "body")).otherwise(F.lit("")),
        F.lit("\n\n## Comments ("), F.size("comments").cast("string"), F.lit(" loaded of "),
        F.coalesce(F.col("announced").cast("string"), F.lit("?")), F.lit(")\n\n"), F.array_join(lines, "\n"), F.lit("\n"),
    )


# ---- posts -------------------------------------------------------------

_POST = (
    "__typename:string,id_str:string,text:string,created_at:string,in_reply_to_screen_name:string,favorite_count:bigint,"
    "conversation_count:bigint,user:struct<name:string,screen_name:string>,"
    "entities:struct<urls:array<struct<url:string,expanded_url:string>>,media:array<struct<url:string>>>,"
    "mediaDetails:array<struct<media_url_https:string,video_info:struct<variants:array<struct<bitrate:bigint,content_type:string,url:string>>>>>"
)
POST_SCHEMA = f"struct<{_POST},tombstone:struct<text:struct<text:string>>,quoted_tweet:struct<{_POST}>>"


def posts(raw: DataFrame, keys: Sequence[str], body: str = "body") -> DataFrame:
    """Post records, with a ``reason`` for the ones that are not available."""
    p = settle(raw, [*keys, body], p=F.from_json(body, POST_SCHEMA))
    empty = F.trim(F.col(body)).isin("", "{}") | F.col("p").isNull()
    gone = first_present("p.tombstone.text.text", "p.__typename")
    reason = F.when(empty, F.lit("not available without login")).when(
        ~F.col("p.__typename").eqNullSafe(F.lit("Tweet")), F.concat(F.lit("not available: "), clean(F.coalesce(gone, F.lit(""))))
    )
    ok = reason.isNull()
    post = F.col("p")
    return p.select(
        *keys,
        reason.alias("reason"),
        F.when(ok, post["user"]["name"]).alias("author"), F.when(ok, post["user"]["screen_name"]).alias("handle"),
        F.when(ok, post["created_at"]).alias("created"), F.when(ok, post["in_reply_to_screen_name"]).alias("reply_to"),
        F.when(ok, expanded_text(post)).alias("text"), F.when(ok, post["favorite_count"]).alias("likes"),
        F.when(ok, post["conversation_count"]).alias("replies"), F.when(ok, best_media(post["mediaDetails"])).alias("media"),
        F.when(ok & post["quoted_tweet"].isNotNull(), post["quoted_tweet"]["user"]["screen_name"]).alias("quoted_handle"),
        F.when(ok & post["quoted_tweet"].isNotNull(), expanded_text(post["quoted_tweet"])).alias("quoted_text"),
        *[F.when(ok, value).alias(f"quoted_{name}") for name, value in (
            ("author", post["quoted_tweet"]["user"]["name"]), ("created", post["quoted_tweet"]["created_at"]), ("likes", post["quoted_tweet"]["favorite_count"]),
            ("replies", post["quoted_tweet"]["conversation_count"]))],
        F.when(ok & post["quoted_tweet"].isNotNull(), best_media(post["quoted_tweet"]["mediaDetails"])).alias("quoted_media"),
        F.when(
            ok,
            F.concat(F.lit("https://x.com/"), F.coalesce(post["user"]["screen_name"], F.lit("i")), F.lit("/status/"), F.coalesce(post["id_str"], F.lit(""))),
        ).alias("url"),
    )


def post_text() -> Column:
    """A post row as Markdown lines, quoted post included."""
    counts = F.concat_ws(
        " · ",
        F.when(F.col("likes").isNotNull(), F.concat(F.lit("Likes: "), thousands("likes"))),
        F.when(F.col("replies").isNotNull(), F.concat(F.lit("Replies: "), thousands("replies"))),
    )
    return F.concat(
        F.lit("**"), F.coalesce("author", F.lit("?")), F.lit("** (@"), F.coalesce("handle", F.lit("?")), F.lit(") · "), F.coalesce("created", F.lit("")),
        F.coalesce(F.concat(F.lit("\nIn reply to @"), F.nullif("reply_to", F.lit(""))), F.lit("")),
        F.lit("\n\n"), "text", F.lit("\n"),
        F.when(counts != "", F.concat(F.lit("\n"), counts)).otherwise(F.lit("")),
        F.when(F.size("media") > 0, F.concat(F.lit("\nMedia:\n- "), F.array_join("media", "\n- "))).otherwise(F.lit("")),
        F.coalesce(F.concat(F.lit("\n\nQuoted: @"), "quoted_handle", F.lit("\n> "), F.regexp_replace("quoted_text", "\n", "\n> ")), F.lit("")),
        F.lit("\n\nURL: "), "url",
    )


# ---- videos and captions ------------------------------------------------

VIDEO_SCHEMA = (
    "struct<_type:string,title:string,channel:string,uploader:string,webpage_url:string,upload_date:string,duration:double,view_count:bigint,"
    "like_count:bigint,description:string,language:string,chapters:array<struct<start_time:double,title:string>>,"
    "subtitles:map<string,array<struct<ext:string>>>,automatic_captions:map<string,array<struct<ext:string>>>,"
    "comments:array<struct<author:string,like_count:bigint,text:string>>,"
    "entries:array<struct<id:string,title:string,url:string,webpage_url:string,duration:double,channel:string,uploader:string,view_count:bigint>>>"
)


def pick_track(manual: Column, auto: Column, language: Column, prefs: Sequence[str], explicit: bool) -> Column:
    """(key, automatic): the caption track to read, from ordered track names.

    Every track is a candidate with a rank for each way it could be meant: a
    requested language (in order of request) or the video's own.  The smallest
    (group, language, exactness, place) wins: requests come before the own
    language where they were made explicitly, hand-made tracks before
    automatic ones, exact names before regional variants.  A hand-made track of
    another language is the last resort; live chat is no track.
    """
    spoken = F.nullif(F.substring_index(F.coalesce(language, F.lit("")), "-", 1), F.lit(""))
    asked, own = (0, 2) if explicit else (1, 0)

    def candidates(pool: Column, automatic: bool) -> Column:
        late = int(automatic)

        def of(key: Column, place: Column) -> Column:
            base = F.substring_index(key, "-", 1)
            rank = lambda hit, group, lang, exact: F.when(
                hit, F.struct(F.lit(group).alias("group"), F.lit(lang).alias("lang"), F.lit(exact).alias("exact"), place.alias("place"), key.alias("key"), F.lit(automatic).alias("automatic")))
            # Own language: hand-made at once, automatic after hand-made requests; both after all requests where these are explicit.
            group_asked, group_own = (asked + late, own + late) if explicit else (asked + 2 * late, own + 2 * late)
            ways = [w for i, p in enumerate(prefs) for w in (rank(key == p, group_asked, i, 0), rank(base == p, group_asked, i, 1))]
            ways += [rank(key == F.concat(spoken, F.lit("-orig")), group_own, 0, -1)] if automatic else []
            ways += [rank(key == spoken, group_own, 0, 0), rank(base == spoken, group_own, 0, 1)]
            return F.array(*ways) if automatic else F.array(*ways, rank(F.lit(True), 9, 0, 0))

        return F.flatten(F.transform(pool, of))

    made = candidates(F.filter(manual, lambda k: k != "live_chat"), False)
    best = F.array_min(F.array_compact(F.concat(made, candidates(auto, True))))
    return F.when(best.isNotNull(), F.struct(best["key"].alias("key"), best["automatic"].alias("automatic")))


def videos(raw: DataFrame, keys: Sequence[str], info: str = "info", prefs: Sequence[str] = ("en",), explicit: bool = False,
           full: bool = False) -> DataFrame:
    """Video records: facts, description, chosen track and its label."""
    v = raw.withColumn("v", F.from_json(info, VIDEO_SCHEMA))
    none = F.array().cast("array<string>")
    track = pick_track(
        F.coalesce(F.map_keys("v.subtitles"), none), F.coalesce(F.map_keys("v.automatic_captions"), none), F.col("v.language"), prefs, explicit
    )
    v = v.withColumn("track", track)
    label = F.when(
        F.col("track").isNotNull(),
        F.concat("track.key", F.when(F.col("track.automatic"), F.lit(" (auto-generated)")).otherwise(F.lit(" (manual)"))),
    ).otherwise(F.lit("not available"))
    about = strip(F.coalesce("v.description", F.lit("")))
    return v.select(
        *keys, F.col("v.title").alias("title"), first_present("v.channel", "v.uploader").alias("channel"), F.col("v.webpage_url").alias("url"),
        day_text(F.coalesce("v.upload_date", F.lit(""))).alias("date"), F.col("v.duration").alias("duration"),
        clock("v.duration").alias("length"), F.col("v.view_count").alias("views"), F.col("v.like_count").alias("likes"),
        (about if full else cut(about, 1500, " […]")).alias("description"), F.col("v.chapters").alias("chapters"),
        F.col("track.key").alias("track"), F.col("track.automatic").alias("automatic"), label.alias("subtitles"), F.col("v.comments").alias("comments"),
    )


def playlist_entries(raw: DataFrame, keys: Sequence[str], info: str = "info", top: int = 30) -> DataFrame:
    """Entries of playlists or video searches, numbered from 1."""
    v = raw.withColumn("v", F.from_json(info, VIDEO_SCHEMA))
    rows = v.select(*keys, F.col("v.title").alias("playlist"), F.posexplode(F.slice("v.entries", 1, top)).alias("i", "e"))
    watch = F.concat(F.lit("https://www.youtube.com/watch?v="), "e.id")
    return rows.select(
        *keys, "playlist", (F.col("i") + 1).alias("n"), F.col("e.title").alias("title"),
        F.coalesce(first_present("e.url", "e.webpage_url"), watch).alias("url"),
        F.col("e.duration").alias("duration"), first_present("e.channel", "e.uploader").alias("channel"), F.col("e.view_count").alias("views"),
    )


def top_comments(comments: DataFrame, keys: Sequence[str], top: int) -> DataFrame:
    """The ``top`` most liked comments per key, the earlier one first among equals."""
    order = Window.partitionBy(*keys).orderBy(F.coalesce("likes", F.lit(0)).desc(), "pos")
    return comments.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= top)


_JSON3 = "struct<events:array<struct<tStartMs:bigint,segs:array<struct<utf8:string>>>>>"


def captions_json3(files: DataFrame, keys: Sequence[str], body: str = "json3") -> DataFrame:
    """(keys, pos, t, text) of json3 caption files; blank lines are dropped."""
    parsed = F.from_json(body, _JSON3)["events"]
    lines = F.transform(
        parsed,
        lambda e: F.struct(
            (F.coalesce(e["tStartMs"], F.lit(0)) / 1000.0).alias("t"),
            clean(F.array_join(F.transform(F.coalesce(e["segs"], F.array().cast("array<struct<utf8:string>>")), lambda s: F.coalesce(s["utf8"], F.lit(""))), "")).alias("text"),
        ),
    )
    rows = files.select(*keys, F.posexplode(F.filter(lines, lambda x: x["text"] != "")).alias("pos", "c"))
    return rows.select(*keys, "pos", "c.t", "c.text")


def captions_vtt(files: DataFrame, keys: Sequence[str], body: str = "vtt") -> DataFrame:
    """(keys, pos, t, text) of WebVTT files: times carried to their lines, rolling repeats removed."""
    keys = list(keys)
    stamp = r"^(?:(\d+):)?(\d{2}):(\d{2})\.\d{3}\s+-->"
    lines = files.select(*keys, F.posexplode(F.split(F.col(body), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")).alias("line", "raw"))
    part = lambda k: F.coalesce(F.regexp_extract("raw", stamp, k).try_cast("int"), F.lit(0))
    is_time = F.col("raw").rlike(stamp)
    t = F.when(is_time, (part(1) * 3600 + part(2) * 60 + part(3)).cast("double"))
    text = strip(unescape(F.regexp_replace("raw", r"<[^>]+>", "")))
    # A caption file is one row, so a window over its lines is as big as that row.
    order = Window.partitionBy(*keys).orderBy("line")
    timed = lines.withColumn("_t", F.last(t, True).over(order)).filter(~is_time).withColumn("text", text)
    shown = timed.filter((F.col("text") != "") & ~F.col("text").rlike("^(WEBVTT|Kind:|Language:|NOTE)"))
    fresh = shown.withColumn("_before", F.lag("text").over(order)).filter(~F.col("_before").eqNullSafe(F.col("text")))
    return fresh.select(*keys, F.col("line").alias("pos"), F.coalesce("_t", F.lit(0.0)).alias("t"), "text")


def with_chapters(captions: DataFrame, chapters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each caption with the latest chapter begun; ``chapter`` is (start, title) or null."""
    marks = chapters.select(
        *keys, F.coalesce("start", F.lit(0.0)).alias("t"), F.struct(F.coalesce("start", F.lit(0.0)).alias("start"), F.col("title")).alias("chapter"), "pos"
    )
    return ordered.latest_before(captions, marks, keys, "t", "chapter", width=600.0, tie="pos")


PARAGRAPH_SOFT, PARAGRAPH_HARD = 500, 900


def paragraphs(captions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Captions of one chapter folded into paragraphs: (keys, chapter, n, t, text).

    A paragraph ends at 500 characters with a sentence mark, or at 900.  The
    fold is sequential, so it runs per chapter over its caption array, which is
    part of one caption file and so of one stored row.
    """
    keys = list(keys)
    line = F.struct("t", "pos", "text")
    per = captions.groupBy(*keys, "chapter").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    start = F.struct(
        F.array().cast("array<struct<t:double,text:string>>").alias("done"), F.array().cast("array<string>").alias("buf"),
        F.lit(0).alias("size"), F.lit(None).cast("double").alias("t0"),
    )

    def step(a: Column, x: Column) -> Column:
        size = a["size"] + F.length(x["text"]) + 1
        full = (size >= PARAGRAPH_HARD) | ((size >= PARAGRAPH_SOFT) & x["text"].rlike(r"[.!?…]$"))
        t0 = F.coalesce(a["t0"], x["t"])
        buf = F.array_append(a["buf"], x["text"])
        para = F.struct(t0.alias("t"), F.array_join(buf, " ").alias("text"))
        return F.when(
            full,
            F.struct(F.array_append(a["done"], para).alias("done"), F.array().cast("array<string>").alias("buf"), F.lit(0).alias("size"), F.lit(None).cast("double").alias("t0")),
        ).otherwise(F.struct(a["done"].alias("done"), buf.alias("buf"), size.alias("size"), t0.alias("t0")))

    def finish(a: Column) -> Column:
        last = F.struct(a["t0"].alias("t"), F.array_join(a["buf"], " ").alias("text"))
        return F.when(F.size(a["buf"]) > 0, F.array_append(a["done"], last)).otherwise(a["done"])

    rows = per.select(*keys, "chapter", F.posexplode(F.aggregate("lines", start, step, finish)).alias("n", "p"))
    return rows.select(*keys, "chapter", (F.col("n") + 1).alias("n"), "p.t", "p.text")


def transcript(captions: DataFrame, chapters: DataFrame, keys: Sequence[str], timestamps: bool = True) -> DataFrame:
    """Transcript lines (keys, t, rank, n, line) in reading order: chapter heads and paragraphs.

    A chapter is shown once a caption at or after its start has been read,
    also when it stays empty.
    """
    keys = list(keys)
    marked = with_chapters(captions, chapters, keys)
    paras = paragraphs(marked, keys)
    prefix = F.concat(F.lit("["), clock("t"), F.lit("] ")) if timestamps else F.lit("")
    body = paras.select(*keys, F.coalesce("chapter.start", F.lit(-1.0)).alias("at"), F.lit(1).alias("rank"), "n", F.concat(prefix, "text").alias("line"))
    last = captions.groupBy(*keys).agg(F.max("t").alias("_end"))
    heads = chapters.withColumn("at", F.coalesce("start", F.lit(0.0))).join(last, keys).filter(F.col("at") <= F.col("_end"))
    head = F.concat(F.lit("### "), F.coalesce("title", F.lit("Chapter")), F.lit(" ("), clock("at"), F.lit(")"))
    return body.unionByName(heads.select(*keys, "at", F.lit(0).alias("rank"), F.col("pos").alias("n"), head.alias("line")))


# ---- catalogues ----------------------------------------------------------

_PRODUCT = (
    "title:string,vendor:string,product_type:string,tags:string,handle:string,images:array<struct<src:string>>,published_at:string,"
    "updated_at:string,variants:array<struct<title:string,sku:string,price:string,compare_at_price:string,available:boolean>>"
)
PAGE_SIZE = 250


def catalogue_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``products``, null where the body is no catalogue page."""
    return pages.withColumn("products", F.from_json(body, f"struct<products:array<struct<{_PRODUCT}>>>")["products"])


def until_short_page(pages: DataFrame, store: str = "store", page_no: str = "page_no", body: str = "body", size: int = PAGE_SIZE) -> DataFrame:
    """Stored pages of each store up to the first that is not full.

    Only the number of products is read for it; bodies stay where they are
    and meet one small row per store.
    """
    n = F.json_array_length(F.get_json_object(body, "$.products"))
    short = pages.groupBy(store).agg(F.min(F.when(n < size, F.col(page_no))).alias("_last"))
    return pages.join(short, store).filter(F.col("_last").isNull() | (F.col(page_no) <= F.col("_last"))).drop("_last")


def _common(p: Column, store: Column) -> list[Column]:
    return [
        p["title"].alias("title"), p["vendor"].alias("vendor"), p["product_type"].alias("type"), list_or_text(p["tags"]).alias("tags"),
        F.concat(store, F.lit("/products/"), p["handle"]).alias("url"), F.get(p["images"], F.lit(0))["src"].alias("image"),
        p["published_at"].alias("published_at"), p["updated_at"].alias("updated_at"),
    ]


def _product_rows(pages: DataFrame, store: str) -> DataFrame:
    # The outer form keeps the optimizer from parsing bodies once more for a size test.
    return pages.select(F.col(store).alias("_store"), F.explode_outer("products").alias("p")).filter(F.col("p").isNotNull())


def products(pages: DataFrame, store: str = "store") -> DataFrame:
    """One row per product, its variants summarised in place."""
    rows = _product_rows(pages, store)
    p = F.col("p")
    prices = F.transform(F.filter(p["variants"], lambda v: F.coalesce(v["price"], F.lit("")) != ""), lambda v: v["price"].try_cast("double"))
    return rows.select(
        F.col("_store").alias(store), *_common(p, F.col("_store")),
        F.array_min(prices).alias("price_min"), F.array_max(prices).alias("price_max"),
        F.coalesce(F.array_size(p["variants"]), F.lit(0)).alias("variants"),
        F.coalesce(F.exists(p["variants"], lambda v: F.coalesce(v["available"], F.lit(False))), F.lit(False)).alias("available"),
    )


def variants(pages: DataFrame, store: str = "store") -> DataFrame:
    """One row per variant; products without variants give none."""
    rows = _product_rows(pages, store).select("_store", "p", F.explode_outer("p.variants").alias("v")).filter(F.col("v").isNotNull())
    return rows.select(
        F.col("_store").alias(store), *_common(F.col("p"), F.col("_store")), F.col("v.title").alias("variant"), F.col("v.sku").alias("sku"),
        F.col("v.price").alias("price"), F.col("v.compare_at_price").alias("compare_at_price"), F.col("v.available").alias("available"),
    )


# ---- repositories, calls, search text -------------------------------------

_REPO = (
    "full_name:string,description:string,stargazers_count:bigint,forks_count:bigint,open_issues_count:bigint,language:string,"
    "license:struct<spdx_id:string>,default_branch:string,created_at:string,pushed_at:string,topics:array<string>,homepage:string,html_url:string"
)


def repositories(raw: DataFrame, keys: Sequence[str], body: str = "body", readme: str | None = None) -> DataFrame:
    r = raw.withColumn("r", F.from_json(body, f"struct<{_REPO}>"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    dash = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("—"))
    text = F.lit("(no README)") if readme is None else F.coalesce(F.col(readme), F.lit("(no README)"))
    return r.select(
        *keys, F.col("r.full_name").alias("full_name"), F.coalesce("r.description", F.lit("")).alias("description"),
        zero("r.stargazers_count").alias("stars"), zero("r.forks_count").alias("forks"), zero("r.open_issues_count").alias("open_issues"),
        dash("r.language").alias("language"), dash("r.license.spdx_id").alias("license"), F.col("r.default_branch").alias("branch"),
        F.left(F.coalesce("r.created_at", F.lit("")), F.lit(10)).alias("created"), F.left(F.coalesce("r.pushed_at", F.lit("")), F.lit(10)).alias("pushed"),
        F.array_join(F.coalesce("r.topics", F.array().cast("array<string>")), ", ").alias("topics"), first_present("r.homepage").alias("homepage"),
        F.col("r.html_url").alias("url"), text.alias("readme"),
    )


def repo_name(path: Column) -> Column:
    """owner/name from a URL path, without a trailing ``.git``."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.concat(F.get(parts, F.lit(0)), F.lit("/"), F.regexp_replace(F.get(parts, F.lit(1)), r"\.git$", ""))


def captured_calls(calls: DataFrame, keys: Sequence[str], body: str = "body", bodies: bool = True) -> DataFrame:
    """Calls a page made: url, status, type, size, and the body as JSON text or its first 5,000 characters."""
    parses = F.try_parse_json(body).isNotNull()
    out = calls.select(
        *keys, "url", "status", F.col("media").alias("type"), F.octet_length(F.col(body)).alias("bytes"),
        F.when(parses, F.col(body)).alias("json"), F.when(~parses, F.left(F.col(body), F.lit(5000))).alias("text"),
    )
    return out if bodies else out.drop("json", "text")


def search_records(results: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Result text with ``Title:``/``URL:``/``Published:`` lines to (keys, n, title, url, published)."""
    lines = F.split(F.col(text), "\n")
    starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).startswith("Title:"))
    value = lambda block, name: F.nullif(F.trim(F.substring_index(
        F.get(F.filter(block, lambda x: x.startswith(name)), F.lit(0)), name, -1)), F.lit(""))

    def record(i: Column, k: Column) -> Column:
        end = F.coalesce(F.get(F.col("_starts"), k + 1), F.size("_lines"))
        return let(
            F.slice("_lines", i + 1, end - i),
            lambda block: F.struct(
                F.trim(F.substr(F.get(block, F.lit(0)), F.lit(7))).alias("title"), value(block, "URL:").alias("url"), value(block, "Published:").alias("published")
            ),
        )

    d = results.withColumn("_lines", lines).withColumn("_starts", F.when(F.size("_lines") > 0, starts))
    rows = d.select(*keys, F.posexplode(F.transform("_starts", record)).alias("n", "r"))
    return rows.select(*keys, (F.col("n") + 1).alias("n"), "r.title", "r.url", "r.published")


def table_cells(doms: DataFrame, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Cells of HTML tables: (keep, table, row, cell, header, text), numbered from 1."""
    nodes = F.col("nodes")

    def cells(tr: Column) -> Column:
        own = F.filter(dom.inside(nodes, tr), lambda n: n["tag"].isin("td", "th") & (n["kind"] == "open") & (n["parent"] == tr["pos"]))
        return F.transform(own, lambda n: F.struct(n["nth"].alias("cell"), (n["tag"] == "th").alias("header"), clean(dom.subtree_text(nodes, n)).alias("text")))

    def rows(tb: Column) -> Column:
        # Rows of a table inside this one belong to that one.
        own = lambda n: F.get(nodes, n["parent"])
        mine = lambda n: (n["parent"] == tb["pos"]) | (own(n)["tag"].isin("thead", "tbody", "tfoot") & (own(n)["parent"] == tb["pos"]))
        trs = F.filter(dom.inside(nodes, tb), lambda n: matches(Step(tag="tr"), n) & mine(n))
        return F.transform(trs, cells)

    tables = F.transform(select(nodes, [Step(tag="table")]), rows)
    t = doms.select(*keep, F.posexplode(tables).alias("table", "rows"))
    r = t.select(*keep, "table", F.posexplode("rows").alias("row", "cells"))
    return r.select(*keep, (F.col("table") + 1).alias("table"), (F.col("row") + 1).alias("row"), F.inline("cells"))
