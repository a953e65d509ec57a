"""Queries that follow links."""

from __future__ import annotations

from pyspark.sql import functions as F

from weblode.catalog import query
from weblode.catalog import twins as t
from weblode.functions import urls
from weblode.operators import dom, graph, verdict
from weblode.operators.select import Pick, Step
from weblode.operators.waves import durable
from weblode.sources import fixtures
from weblode.sources.responses import table

_DOMAIN = f"regexp_extract({t.host('url')}, '([^.]+\\.[^.]+)$', 1)"


@query("sitemap_urls", f"select distinct 'https://' || {_DOMAIN} as site, url from pages")
def sitemap_urls(spark, root):
    roots = graph.sitemap_roots(fixtures.robots_files(spark, root))
    return graph.expand_sitemaps(roots, fixtures.sitemap_documents(spark, root)).select("site", "url")


@query(
    "sitemap_top",
    f"""select site, n, url from (
      select 'https://' || {_DOMAIN} as site, url, row_number() over (partition by {_DOMAIN} order by
        case when {_DOMAIN} = 'example.org' and page_id // 2500 = 0 then 'sitemap.xml' else 'index-' || (page_id // 2500) || '.xml' end,
        'https://' || {t.netloc('url')} || '/sitemap-' || lpad((page_id // 50)::varchar, 6, '0'), page_id) as n
      from pages where regexp_matches(url, '/(en|de)/')) where n <= 20""",
)
def sitemap_top(spark, root):
    """The first 20 matching URLs of each site, as its sitemaps list them."""
    from pyspark.sql import Window

    roots = graph.sitemap_roots(fixtures.robots_files(spark, root))
    found = graph.expand_sitemaps(roots, fixtures.sitemap_documents(spark, root), match="/(en|de)/", limit=20)
    return found.select("site", F.row_number().over(Window.partitionBy("site").orderBy("path")).alias("n"), "url")


_GRAPH = f"""
pg as (select page_id, split_part(url, '#', 1) as url, {t.host('url')} as host, page_id % 13 <> 7 as usable from pages),
nx as (select *, coalesce(lead(url) over w, first_value(url) over w) as next_url from pg window w as (partition by host order by page_id rows between unbounded preceding and unbounded following))
"""


#: One row a URL: that of the smallest id.
_ONE = "one as (select url, min(page_id) as page_id, arg_min(next_url, page_id) as next_url, arg_min(usable, page_id) as usable from nx group by url)"


@query(
    "paginate_rows",
    f"""with recursive {_GRAPH}, {_ONE},
    st as (select distinct arg_min(url, page_id) as url from pg group by host),
    ch(start, page_no, url, next_url, trail) as (
      select st.url, 1, one.url, one.next_url, [one.url] from st join one on one.url = st.url and one.usable
      union all select ch.start, page_no + 1, one.url, one.next_url, list_append(trail, one.url) from ch join one on one.url = ch.next_url and one.usable
      where page_no < 5 and not list_contains(trail, ch.next_url)),
    r as (select start, page_no, ch.url, k as _row, row_number() over (partition by start order by page_no, k) as n
          from ch join one on one.url = ch.url, unnest(range(1, page_id % 3 + 2)) as u(k))
    select start, page_no, url, _row from r where n <= 4""",
)
def paginate_rows(spark, root):
    """Up to five pages after the first page of each host, rows cut at four per chain."""
    pages, _ = fixtures.page_graph(spark, root)
    starts = pages.groupBy("host").agg(F.min_by("url", "page_id").alias("url"))
    chain = graph.paginate(starts, pages)
    rows = graph.one_per_url(pages).select("url", F.explode(F.sequence(F.lit(1).cast("long"), F.col("page_id") % 3 + 1)).alias("_row"))
    return graph.accumulated(chain, rows, limit=4).select("start", "page_no", "url", "_row")


@query(
    "paginate_linked",
    f"""with recursive pg as (select page_id, split_part(url, '#', 1) as url, {_DOMAIN} as domain, page_id % 97 <> 13 as usable from pages),
    nx as (select *, lead(url) over (partition by domain order by page_id) as next_url from pg), {_ONE},
    st as (select distinct arg_min(url, page_id) as url from pg group by domain),
    ch(start, page_no, url, next_url, trail) as (
      select st.url, 1, one.url, one.next_url, [one.url] from st join one on one.url = st.url and one.usable
      union all select ch.start, page_no + 1, one.url, one.next_url, list_append(trail, one.url) from ch join one on one.url = ch.next_url and one.usable
      where page_no < 1500 and not list_contains(trail, ch.next_url))
    select start, page_no, url from ch""",
)
def paginate_linked(spark, root):
    """Chains of up to 1,500 pages, each next page read from its page by a selector."""
    answers = fixtures.linked_pages(spark, root)
    links = graph.next_links(dom.with_nodes(answers), Pick(((Step(tag="a", attrs=(("rel", "=", "next"),)),),), "attr:href"), keep=("page_id", "status"))
    pages = links.withColumn("usable", verdict.status_rule(F.col("status")).isNull())
    domain = F.regexp_extract(urls.host("url"), r"([^.]+\.[^.]+)$", 1)
    starts = table(spark, root, "pages").groupBy(domain).agg(urls.drop_fragment(F.min_by("url", "page_id")).alias("url"))
    return graph.paginate(starts, pages, max_pages=1500)


_ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /fr/\nAllow: /fr/8\nDisallow: /*?utm\n"


def _crawl(spark, root):
    pages, links = fixtures.page_graph(spark, root)
    domain = F.regexp_extract(urls.host("url"), r"([^.]+\.[^.]+)$", 1)
    starts = pages.groupBy(domain.alias("domain")).agg(F.min_by("url", "page_id").alias("url"))
    robots = pages.select("host").distinct().withColumn("body", F.lit(_ROBOTS))
    return starts, links, graph.robots_rules(robots)


_REACH = f"""
{_GRAPH}, tot as (select max(page_id) + 1 as n from pg),
lk as (select distinct a.url as source, b.url from pg a cross join tot, unnest([(2 * page_id + 1) % n, (2 * page_id + 2) % n, (3 * page_id + 5) % n, (5 * page_id + 7) % n, (7 * page_id + 11) % n, (11 * page_id + 3) % n]) as u(k) join pg b on b.page_id = k),
okp as (select url, regexp_extract(host, '([^.]+\\.[^.]+)$', 1) as domain from pg
        where (not starts_with({t.path('url')}, '/fr/') or starts_with({t.path('url')}, '/fr/8')) and not regexp_matches(url, '\\?utm')),
st as (select regexp_extract(host, '([^.]+\\.[^.]+)$', 1) as domain, arg_min(url, page_id) as url from pg group by 1),
rc(domain, url, depth) as (
  select st.domain, st.url, 0 from st join okp using (url)
  union select rc.domain, lk.url, depth + 1 from rc join lk on lk.source = rc.url join okp on okp.url = lk.url and okp.domain = rc.domain
  where depth < 40 and not regexp_matches(lk.url, '/de/9')),
best as (select domain, url, min(depth) as depth from rc group by all)
"""


@query("crawl_reach", f"with recursive {_REACH} select domain, url, depth from best")
def crawl_reach(spark, root):
    """What a crawl of each domain reaches, robots rules obeyed, one pattern denied."""
    starts, links, rules = _crawl(spark, root)
    return graph.reach(starts, links, deny=["/de/9"], rules=rules)


@query(
    "crawl_capped",
    f"with recursive {_REACH} select domain, url, depth from (select *, row_number() over (partition by domain order by depth, url) as n from best) where n <= 10",
)
def crawl_capped(spark, root):
    starts, links, rules = _crawl(spark, root)
    return graph.reach(starts, links, max_pages=10, deny=["/de/9"], rules=rules)


@query("crawl_resumed", f"with recursive {_REACH} select domain, url from best")
def crawl_resumed(spark, root):
    """A crawl stopped after ten pages a domain and continued from its frontier reaches what one in a single run does."""
    starts, links, rules = _crawl(spark, root)
    first = durable(graph.reach(starts, links, max_pages=10, deny=["/de/9"], rules=rules).select("domain", "url"), "first_run")
    rest = graph.reach(graph.frontier(first, links, deny=["/de/9"]), links, deny=["/de/9"], rules=rules, visited=first)
    return first.unionByName(rest.select("domain", "url"))


@query(
    "crawl_records",
    f"""with recursive {_REACH} select domain, kind, count(*) as pages from (
      select domain, case when regexp_matches(url, '/en/\\d') then 'english' when regexp_matches(url, '/[a-z][a-z]/') then 'other' end as kind from best) where kind is not null group by all""",
)
def crawl_records(spark, root):
    """Reached pages by the record kind their address calls for."""
    starts, links, rules = _crawl(spark, root)
    reached = graph.reach(starts, links, deny=["/de/9"], rules=rules)
    return graph.follow_rules(reached, [(r"/en/\d", "english"), (r"/[a-z][a-z]/", "other")]).groupBy("domain", "kind").agg(F.count("*").alias("pages"))


#: Robots files of four kinds: a shared group, two groups of one agent, only another agent, ties.
_FILES = (
    "# french\nUser-agent: *\nUser-agent: Bot # both\nDisallow: /fr/ # all of it\n",
    "User-agent: bot\nDisallow: /en/\n\nUser-agent: *\nDisallow: /\n\nUSER-AGENT: BOT\nAllow: /en/1\nDisallow: /*/2$\n",
    "User-agent: other\nDisallow: /\n",
    "User-agent: *\nDisallow:\nDisallow: /de/\nAllow: /de/\nDisallow: /es/\n",
)
_TARGET = f"{t.path('url')} || case when {t.url_query('url')} <> '' then '?' || {t.url_query('url')} else '' end"


@query(
    "robots_allowed",
    f"""select page_id from (select page_id, length({t.host('url')}) % 4 as k, {_TARGET} as p from pages)
    where case k when 0 then not starts_with(p, '/fr/')
      when 1 then starts_with(p, '/en/1') or not (starts_with(p, '/en/') or regexp_matches(p, '^/.*/2$'))
      when 3 then not starts_with(p, '/es/') else true end""",
)
def robots_allowed(spark, root):
    """Pages that one named agent may read."""
    pages = table(spark, root, "pages").select("page_id", "url")
    body = F.element_at(F.array(*[F.lit(x) for x in _FILES]), F.length("host") % 4 + 1)
    robots = pages.select(urls.host("url").alias("host")).distinct().withColumn("body", body)
    return graph.allowed_by_robots(pages, graph.robots_rules(robots, "bot")).select("page_id")


@query(
    "sitemap_batch",
    f"""select 'https://' || {_DOMAIN} as site, url, min(page_id) as page_id, 'ok' as outcome from pages where page_id % 9 <> 4 group by all
    union all select 'https://' || {_DOMAIN}, url, null, 'nothing is stored' from pages group by 1, 2 having bool_and(page_id % 9 = 4)""",
)
def sitemap_batch(spark, root):
    """The URLs that sitemaps list beside the stored answers, of which every ninth is missing."""
    from weblode.plans import jobs
    from weblode.sources import responses

    roots = graph.sitemap_roots(fixtures.robots_files(spark, root))
    listed = graph.expand_sitemaps(roots, fixtures.sitemap_documents(spark, root)).select("site", "url")
    stored = responses.lift(table(spark, root, "pages").filter("page_id % 9 <> 4"))
    answers = jobs.fetched(listed, stored)
    out = answers.groupBy("site", "url").agg(F.min("page_id").alias("page_id"), F.min(F.coalesce("problem.reason", F.lit("ok"))).alias("outcome"))
    return out
