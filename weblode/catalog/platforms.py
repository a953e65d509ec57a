"""Queries over platform records."""

from __future__ import annotations

from pyspark.sql import functions as F

from weblode.catalog import query
from weblode.catalog import twins as t
from weblode.functions import urls
from weblode.operators import dom, extract, platforms
from weblode.sources import fixtures


@query(
    "feed_items",
    f"""select source, block, source as feed_title, n, title, link, date, text from (
      select source, doc_id // 400 as block, row_number() over (partition by source, doc_id // 400 order by doc_id) as n,
        case when doc_id % 11 = 0 or {t.clean('left(text, 60)')} = '' then '(untitled)' else {t.clean('left(text, 60)')} end as title,
        'https://' || source || '.example.com/d/' || doc_id as link, '2024-01-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') as date,
        left({t.clean('text')}, 300) as text
      from documents) where n <= 15""",
)
def feed_items(spark, root):
    return platforms.feed_items(fixtures.feeds(spark, root), ["source", "block"])


@query(
    "feed_items_full",
    f"""select source, block, n, title, text from (
      select source, doc_id // 400 as block, row_number() over (partition by source, doc_id // 400 order by doc_id) as n,
        case when doc_id % 11 = 0 or {t.clean('left(text, 60)')} = '' then '(untitled)' else {t.clean('left(text, 60)')} end as title, {t.clean('text')} as text
      from documents)""",
)
def feed_items_full(spark, root):
    """All entries of all feeds with their whole texts."""
    return platforms.feed_items(fixtures.feeds(spark, root), ["source", "block"], top=0, full=True).select("source", "block", "n", "title", "text")


@query(
    "feed_discovery",
    f"""select page_id, case when page_id % 3 = 0 then {t.scheme('url')} || '://' || {t.netloc('url')} || '/feed/' || page_id || '.xml' end as feed,
    case when page_id % 3 <> 0 then 'no feed is advertised' end as reason from pages""",
)
def feed_discovery(spark, root):
    found = platforms.discovered_feed(F.col("html"), F.col("url"))
    return fixtures.pages_with_feed(spark, root).select("page_id", found.alias("f")).select("page_id", "f.feed", "f.reason")


def _threads(spark, root):
    return platforms.threads(dom.with_nodes(fixtures.thread_pages(spark, root)), keep=("conv_id", "block", "url"))


@query(
    "thread_comments",
    f"""select conv_id, row_number() over (partition by conv_id order by turn) as n, role as author, ((turn - 1) % 3)::int as depth, (turn * 2)::varchar as score,
    '2024-02-03' as created, {t.clean('text')} as text, 'https://www.reddit.com/r/c/comments/' || conv_id || '/comment/' || turn || '/' as url
    from conversations where turn > 0 and turn % 5 <> 0 and {t.clean('text')} <> ''""",
)
def thread_comments(spark, root):
    rows = _threads(spark, root).select("conv_id", "block", F.posexplode_outer("comments").alias("n", "c")).filter(F.col("n").isNotNull())
    return rows.select("conv_id", (F.col("block") * 100 + F.col("n") + 1).alias("n"), "c.*")


@query(
    "thread_summary",
    f"""select conv_id, 'Thread ' || conv_id as title, 'user' || conv_id as author, {t.clean('arg_min(text, turn)')} as body, count(*)::int as announced,
    count(*) filter (turn > 0 and turn % 5 <> 0 and trim(text) <> '') as loaded,
    round(count(*) filter (turn > 0 and turn % 5 <> 0 and trim(text) <> '') / count(*), 6) as completeness
    from conversations group by conv_id""",
)
def thread_summary(spark, root):
    # A thread's blocks are summed; its post is on each of them.
    from weblode.functions.text import clean

    g = _threads(spark, root).groupBy("conv_id").agg(
        F.min("title").alias("title"), F.min("author").alias("author"), clean(F.min("body")).alias("body"), F.max("announced").alias("announced"),
        F.sum(F.size("comments")).alias("loaded"),
    )
    return g.withColumn("completeness", F.round(F.col("loaded") / F.col("announced"), 6))


@query(
    "thread_markdown",
    f"""with c as (select *, {t.clean('text')} as said, (turn > 0 and turn % 5 <> 0 and {t.clean('text')} <> '') as loaded from conversations)
    select conv_id, 0 as block, '# Thread ' || conv_id || chr(10) || 'r/c · u/user' || conv_id || ' · 2024-02-03 · 33 points · ' || count(*) || ' comments' || chr(10)
      || 'URL: https://www.reddit.com/r/c/comments/' || conv_id || '/?part=0' || chr(10) || chr(10) || arg_min(said, turn) || chr(10) || chr(10)
      || '## Comments (' || count(*) filter (loaded) || ' loaded of ' || count(*) || ')' || chr(10) || chr(10)
      || coalesce(string_agg(repeat('  ', ((turn - 1) % 3)::int) || '- **u/' || role || '** (' || (turn * 2) || ' pts): ' || said, chr(10) order by turn) filter (loaded), '') || chr(10) as markdown
    from c group by conv_id""",
)
def thread_markdown(spark, root):
    return _threads(spark, root).select("conv_id", "block", platforms.thread_text().alias("markdown"))


_POST = """p0 as (select *, conv_id * 1000 + turn as n, 'see https://example.com/' || (conv_id * 1000 + turn) || ' ' || text as full_text from conversations),
p1 as (select *, lag(full_text) over w as q_text, lag(role) over w as q_role, lag(turn) over w as q_turn from p0 window w as (partition by conv_id order by turn))"""


@query(
    "posts_flat",
    f"""with {_POST} select n as post_id, case when n % 9 = 0 then 'not available: This post is unavailable.' end as reason,
    case when n % 9 <> 0 then 'Name ' || role end as author, case when n % 9 <> 0 then role end as handle, case when n % 9 <> 0 then {t.strip(t.unescape('full_text'))} end as text,
    case when n % 9 <> 0 then n * 7 end as likes, case when n % 9 <> 0 then turn end as replies,
    case when n % 9 <> 0 then 'https://v/high/' || n || ' https://img2/' || n end as media,
    case when n % 9 <> 0 and n % 6 = 0 and q_turn = turn - 1 then q_role end as quoted_handle,
    case when n % 9 <> 0 and n % 6 = 0 and q_turn = turn - 1 then {t.strip(t.unescape('q_text'))} end as quoted_text,
    case when n % 9 <> 0 then 'https://x.com/' || role || '/status/' || n end as url from p1""",
)
def posts_flat(spark, root):
    p = platforms.posts(fixtures.post_bodies(spark, root), ["post_id"])
    return p.select("post_id", "reason", "author", "handle", "text", "likes", "replies", F.array_join("media", " ").alias("media"), "quoted_handle", "quoted_text", "url")


@query(
    "posts_markdown",
    f"""with {_POST} select n as post_id, '**Name ' || role || '** (@' || role || ') · 2024-01-01T00:00:00.000Z' || chr(10) || chr(10) || {t.strip(t.unescape('full_text'))} || chr(10)
      || chr(10) || 'Likes: ' || format('{{:,}}', n * 7) || ' · Replies: ' || turn || chr(10) || 'Media:' || chr(10) || '- https://v/high/' || n || chr(10) || '- https://img2/' || n
      || case when n % 6 = 0 and q_turn = turn - 1 then chr(10) || chr(10) || 'Quoted: @' || q_role || chr(10) || '> ' || replace({t.strip(t.unescape('q_text'))}, chr(10), chr(10) || '> ') else '' end
      || chr(10) || chr(10) || 'URL: https://x.com/' || role || '/status/' || n as markdown from p1 where n % 9 <> 0""",
)
def posts_markdown(spark, root):
    p = platforms.posts(fixtures.post_bodies(spark, root), ["post_id"])
    return p.filter(F.col("reason").isNull()).select("post_id", platforms.post_text().alias("markdown"))


@query(
    "video_records",
    """select conv_id, block, 'Video ' || conv_id as title, case when conv_id % 4 = 1 then 'up' else 'chan' end as channel,
    case when conv_id % 4 = 2 then '2024' else '2024-03-05' end as date, n * 7.5::double as duration,
    (n * 15 // 2 // 60) || ':' || lpad((n * 15 // 2 % 60)::varchar, 2, '0') as length, conv_id * 1000 as views, conv_id as likes, 'about ' || conv_id as description,
    ((n + 2) // 3)::int as chapters, case conv_id % 4 when 0 then 'en' when 1 then 'de-orig' when 2 then 'pt-BR' end as track,
    case conv_id % 4 when 0 then 'en (manual)' when 1 then 'de-orig (auto-generated)' when 2 then 'pt-BR (manual)' else 'not available' end as subtitles
    from (select conv_id, turn // 200 as block, count(*) as n from conversations group by all)""",
)
def video_records(spark, root):
    v = platforms.videos(fixtures.video_files(spark, root), ["conv_id", "block"], prefs=("pt",))
    return v.select("conv_id", "block", "title", "channel", "date", "duration", "length", "views", "likes", "description",
                    F.size("chapters").alias("chapters"), "track", "subtitles")


@query(
    "video_tracks",
    """select conv_id, case conv_id % 4 when 0 then 'en' when 1 then 'es' when 2 then 'en' end as track,
    case conv_id % 4 when 0 then false when 1 then true when 2 then true end as automatic from (select distinct conv_id, turn // 200 from conversations)""",
)
def video_tracks(spark, root):
    """Track choice when Spanish, then English is asked for."""
    v = platforms.videos(fixtures.video_files(spark, root), ["conv_id", "block"], prefs=("es", "en"), explicit=True)
    return v.select("conv_id", "track", "automatic")


@query(
    "playlist_entries",
    """select p_brand, block, n, title, url, duration, channel, views from (
      select p_brand, p_partkey // 100 as block, row_number() over (partition by p_brand, p_partkey // 100 order by p_partkey) as n, p_name as title,
        case p_partkey % 3 when 0 then 'https://v.example.com/' || p_partkey when 1 then 'https://w.example.com/' || p_partkey else 'https://www.youtube.com/watch?v=v' || p_partkey end as url,
        p_size::double as duration, p_type as channel, p_partkey as views from part) where n <= 3""",
)
def playlist_entries(spark, root):
    return platforms.playlist_entries(fixtures.playlists(spark, root), ["p_brand", "block"], top=3).drop("playlist")


@query(
    "top_comments",
    """select conv_id, n, turn as pos, length(text) as likes from (select *, row_number() over (partition by conv_id order by length(text) desc, turn) as n from conversations) where n <= 2""",
)
def top_comments(spark, root):
    from weblode.sources.responses import table

    c = table(spark, root, "conversations").select("conv_id", F.col("turn").alias("pos"), F.length("text").cast("long").alias("likes"))
    return platforms.top_comments(c, ["conv_id"], 2).select("conv_id", "n", "pos", "likes")


_WORDS = t.clean("text")


@query(
    "captions_json3",
    f"""select conv_id, block, row_number() over (partition by conv_id, block order by turn) - 1 as pos, (turn % 200) * 7.5::double as t, text from (
      select conv_id, turn // 200 as block, turn, {_WORDS} as text from conversations) where text <> ''""",
)
def captions_json3(spark, root):
    return platforms.captions_json3(fixtures.video_files(spark, root), ["conv_id", "block"])


@query(
    "captions_vtt",
    f"""with w as (select conv_id, turn // 200 as block, turn, {_WORDS} as text from conversations),
    l as (select *, lag(text) over (partition by conv_id, block order by turn) as prev from w)
    select conv_id, block, floor((turn % 200) * 7.5)::double as t, text from l where text <> '' and text is distinct from prev""",
)
def captions_vtt(spark, root):
    return platforms.captions_vtt(fixtures.video_files(spark, root), ["conv_id", "block"]).drop("pos")


def _chapters(spark, root):
    v = platforms.videos(fixtures.video_files(spark, root), ["conv_id", "block"])
    rows = v.select("conv_id", "block", F.posexplode_outer("chapters").alias("pos", "c")).filter(F.col("pos").isNotNull())
    return rows.select("conv_id", "block", "pos", F.col("c.start_time").alias("start"), F.col("c.title").alias("title"))


@query(
    "caption_chapters",
    f"""select conv_id, block, t, text, 'Part ' || (turn % 200 // 3) as chapter from (
      select conv_id, turn // 200 as block, turn, (turn % 200) * 7.5::double as t, {_WORDS} as text from conversations) where text <> ''""",
)
def caption_chapters(spark, root):
    caps = platforms.captions_json3(fixtures.video_files(spark, root), ["conv_id", "block"])
    out = platforms.with_chapters(caps, _chapters(spark, root), ["conv_id", "block"])
    return out.select("conv_id", "block", "t", "text", F.col("chapter.title").alias("chapter"))


#: The fold line by line: a paragraph is left when it has 500 characters and a sentence mark, or 900.
_FULL = "(size >= 900 or size >= 500 and regexp_matches(buf, '[.!?…]$'))"
_CLOCK = "floor({0} / 60)::int || ':' || lpad((floor({0})::int % 60)::varchar, 2, '0')"


@query(
    "transcript_paragraphs",
    f"""with recursive w as (select conv_id, turn // 200 as block, turn % 200 // 3 as k, turn, (turn % 200) * 7.5::double as t, {_WORDS} as text from conversations),
    c as (select *, row_number() over (partition by conv_id, block, k order by turn) as i from w where text <> ''),
    fold as (
      select conv_id, block, k, i, 1 as n, length(text) + 1 as size, t as t0, text as buf from c where i = 1
      union all
      select f.conv_id, f.block, f.k, c.i, case when {_FULL} then n + 1 else n end, case when {_FULL} then 0 else size end + length(c.text) + 1,
        case when {_FULL} then c.t else t0 end, case when {_FULL} then c.text else buf || ' ' || c.text end
      from fold f join c on c.conv_id = f.conv_id and c.block = f.block and c.k = f.k and c.i = f.i + 1)
    select conv_id, block, k * 22.5::double as at, 1 as rank, n, '[' || {_CLOCK.format("min(t0)")} || '] ' || arg_max(buf, i) as line from fold group by conv_id, block, k, n
    union all
    select conv_id, block, k * 22.5::double, 0, k, '### Part ' || k || ' (' || {_CLOCK.format("(k * 22.5)")} || ')'
    from (select distinct conv_id, block, k from w) join (select conv_id, block, max(t) as fin from c group by all) using (conv_id, block) where k * 22.5 <= fin""",
)
def transcript_paragraphs(spark, root):
    caps = platforms.captions_json3(fixtures.video_files(spark, root), ["conv_id", "block"])
    return platforms.transcript(caps, _chapters(spark, root), ["conv_id", "block"])


_PARTS = """
v as (select l_partkey, l_suppkey, l_suppkey // 200 as sblock, round(min(l_extendedprice) * 100)::bigint as cents, l_partkey % 5 <> 0 and l_suppkey % 2 = 0 as ok
      from lineitem group by all),
pr as (select *, 'https://shop' || (p_partkey % 4) || '-' || sblock || '.example.com' as store, p_partkey // 1000 as page_no from part join v on l_partkey = p_partkey
      where not (p_partkey % 4 = 3 and p_partkey // 4 between 10 and 12)),
pg as (select store, page_no, count(distinct p_partkey) as n from pr group by all),
cut as (select store, min(page_no) filter (n < 250) as last from pg group by store),
kept as (select pr.* from pr join cut using (store) where last is null or page_no <= last)
"""
_TAGS = "case when p_partkey % 2 = 0 then p_type || ', ' || p_brand else p_type end as tags"


@query(
    "catalogue_products",
    f"""with {_PARTS} select store, store || '/products/p-' || p_partkey as url, any_value(p_name) as title, any_value(p_brand) as vendor, any_value(tags) as tags,
    case when p_partkey % 3 <> 0 then 'https://img/' || p_partkey end as image, min(case when l_suppkey % 10 <> 3 then cents / 100 end) as price_min,
    max(case when l_suppkey % 10 <> 3 then cents / 100 end) as price_max, count(*)::int as variants, bool_or(ok) as available
    from (select *, {_TAGS} from kept) group by store, p_partkey""",
)
def catalogue_products(spark, root):
    pages = platforms.catalogue_pages(platforms.until_short_page(fixtures.catalogue_bodies(spark, root)))
    return platforms.products(pages).select("store", "url", "title", "vendor", "tags", "image", "price_min", "price_max", "variants", "available")


@query(
    "catalogue_variants",
    f"""with {_PARTS} select store, store || '/products/p-' || p_partkey as url, 'S' || l_suppkey as variant, p_partkey || '-' || l_suppkey as sku,
    case when l_suppkey % 10 <> 3 then (cents // 100) || '.' || lpad((cents % 100)::varchar, 2, '0') end as price, ok as available from kept""",
)
def catalogue_variants(spark, root):
    pages = platforms.catalogue_pages(platforms.until_short_page(fixtures.catalogue_bodies(spark, root)))
    return platforms.variants(pages).select("store", "url", "variant", "sku", "price", "available")


@query(
    "repos_flat",
    """select s_suppkey, 'org/repo' || s_suppkey as full_name, case when s_suppkey % 4 <> 0 then s_name else '' end as description, s_suppkey * 100 as stars, s_suppkey as forks,
    s_suppkey % 13 as open_issues, case when s_suppkey % 3 <> 0 then 'Python' else '—' end as language, case when s_suppkey % 5 <> 0 then 'MIT' else '—' end as license,
    'main' as branch, '2020-05-06' as created, '2024-05-06' as pushed, case when s_suppkey % 2 = 0 then 'a, t' || s_suppkey else '' end as topics,
    case when s_suppkey % 7 <> 0 then 'https://home/' end as homepage, 'https://github.com/org/repo' || s_suppkey as url, '(no README)' as readme from supplier""",
)
def repos_flat(spark, root):
    return platforms.repositories(fixtures.repo_bodies(spark, root), ["s_suppkey"])


@query(
    "captured_calls",
    """with g as (select event_id // 50 as page, count(*) as n, any_value(m) as m, page % 8 = 7 and page // 8 % 10 = 9 as plain
      from events cross join (select max(event_id) // 50 as m from events) group by 1)
    select page, 'https://app.example.com/api/c' || page % 8 || '/events?page=' || page // 8 || '&size=50' as url, 200 as status,
      case when plain then 'text/plain' else 'application/json' end as type, case when not plain then page + 8 <= m end as has_next,
      case when not plain then n end as rows, case when plain then 'plain answer ' || page end as text from g""",
)
def captured_calls(spark, root):
    c = platforms.captured_calls(fixtures.captured(spark, root), ["page"])
    j = F.from_json("json", "struct<has_next:boolean,rows:array<struct<event_id:bigint>>>")
    return c.withColumn("j", j).select("page", "url", "status", "type", F.col("j.has_next").alias("has_next"),
                                       F.when(F.col("j").isNotNull(), F.size("j.rows")).cast("long").alias("rows"), "text")


@query(
    "api_templates",
    """select 'https://app.example.com/api/c' || page % 8 || '/events?page={}&size=50' as template, count(*) as calls, min(page) as first_page, max(page) as last_page
    from (select distinct event_id // 50 as page from events) group by page % 8""",
)
def api_templates(spark, root):
    """Endpoints behind a page: calls that match a pattern, grouped by address template."""
    c = platforms.captured_calls(fixtures.captured(spark, root), ["page"], bodies=False).filter(F.col("url").rlike(r"/api/.*page=\d+"))
    return c.groupBy(urls.page_template("url").alias("template")).agg(F.count("*").alias("calls"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


@query(
    "api_rows",
    "select event_id, event_type, user_id from events where event_id // 50 % 8 <> 7 or event_id // 50 // 8 < 9",
)
def api_rows(spark, root):
    """Rows of numbered API pages until one says it is the last, or does not parse."""
    j = F.from_json("body", "struct<has_next:boolean,rows:array<struct<event_id:bigint,event_type:string,user_id:bigint>>>")
    c = fixtures.captured(spark, root).withColumn("api", urls.page_template("url")).withColumn("j", j)
    stop = c.groupBy("api").agg(
        F.min(F.when(F.col("j.rows").isNull(), F.col("page"))).alias("broken"), F.min(F.when(~F.col("j.has_next"), F.col("page"))).alias("last"))
    kept = c.join(stop, "api").filter((F.col("broken").isNull() | (F.col("page") < F.col("broken"))) & (F.col("last").isNull() | (F.col("page") <= F.col("last"))))
    return kept.select(F.inline("j.rows"))


@query(
    "search_records",
    f"""select url, title, published, query_id from (
      select *, row_number() over (partition by url order by doc_id) as k from (
        select doc_id, doc_id // 10 as query_id, trim({t.clean('left(text, 40)')}) as title, 'https://' || source || '.example.com/' || (doc_id % 200) as url,
          case when doc_id % 4 <> 0 then '2024-01-02' end as published from documents)) where k = 1""",
)
def search_records(spark, root):
    """Results of all searches, the first occurrence of each URL."""
    from weblode.functions.text import clean

    r = platforms.search_records(fixtures.search_results(spark, root), ["query_id"])
    first = r.groupBy("url").agg(F.min(F.struct("query_id", "n", clean("title").alias("title"), "published")).alias("r"))
    return first.select("url", "r.title", "r.published", "r.query_id")


@query(
    "nth_child_cells",
    """select r_regionkey as page_id, row, cell, header, text from (
      select r_regionkey, 1 as row, 1 as cell, true as header, 'Key' as text from region union all select r_regionkey, 1, 2, true, r_name from region
      union all select n_regionkey, 1 + row_number() over (partition by n_regionkey order by n_nationkey), 1, false, n_nationkey::varchar from nation
      union all select n_regionkey, 1 + row_number() over (partition by n_regionkey order by n_nationkey), 2, false, n_name from nation)""",
)
def nth_child_cells(spark, root):
    return platforms.table_cells(dom.with_nodes(fixtures.table_pages(spark, root))).drop("table")


@query(
    "embedded_jsonld",
    """select p_partkey as page_id, 'jsonld' as kind, 'jsonld' as key, p_name as value from part where p_partkey % 8 <> 0
    union all select p_partkey, 'script', '__NEXT_DATA__', p_partkey::varchar from part
    union all select p_partkey, 'script', 'json_1', p_partkey::varchar from part""",
)
def embedded_jsonld(spark, root):
    d = dom.with_nodes(fixtures.embedded_pages(spark, root))
    entry = lambda kind, key, body: F.struct(F.lit(kind).alias("kind"), key.alias("key"), body.alias("body"))
    found = F.concat(
        F.transform(extract.jsonld_texts(), lambda b: entry("jsonld", F.lit("jsonld"), b)),
        F.transform(extract.json_script_array(), lambda x: entry("script", x["key"], x["body"])))
    v = F.try_parse_json("body")
    value = F.coalesce(F.try_variant_get(v, "$.name", "string"), F.try_variant_get(v, "$.k", "string"), F.try_variant_get(v, "$.second", "string"))
    return d.select("page_id", F.inline(found)).select("page_id", "kind", "key", value.alias("value"))


@query(
    "embedded_state",
    """select p_partkey as page_id, '__STATE_A__' as key, '{"size": ' || p_size || ', "s": "a};{\\"b"}' as body from part
    union all select p_partkey, '__LIST__', '[1, [2]]' from part where p_partkey % 8 <> 0""",
)
def embedded_state(spark, root):
    return extract.state_assignments(dom.with_nodes(fixtures.embedded_pages(spark, root)))
