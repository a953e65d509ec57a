"""Queries that run composed jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from weblode.catalog import query
from weblode.catalog import twins as t
from weblode.catalog.graphs import _REACH, _crawl
from weblode.catalog.pages import _FOCUS, _MARKDOWN
from weblode.operators.select import Field, Pick, Step
from weblode.plans import jobs
from weblode.operators.waves import fresh_path
from weblode.sources import fixtures, responses, rulesets, sinks
from weblode.sources.responses import table


@query(
    "page_report",
    t.page_sql(
        """select p.page_id, coalesce(title, '') as title, (select count(*)::int from nodes n where n.page_id = p.page_id and n.tag = 'a') as anchors,
        (select count(*)::int from nodes n where n.page_id = p.page_id and n.tag = 'script') as scripts from pages p left join titles using (page_id)"""
    ),
)
def page_report(spark, root):
    return jobs.page_report(responses.pages(spark, root)).select("page_id", F.coalesce("title", F.lit("")).alias("title"), "anchors", "scripts")


@query(
    "page_documents",
    t.page_sql(
        f"""select p.page_id, 'url,status' || case when title <> '' then ',title' else '' end || case when l.links > 0 then ',meta,links' else ',meta' end
          || case when exists (select 1 from nodes b where b.page_id = p.page_id and b.tag = 'body') then ',outline' else '' end as parts,
          coalesce(l.links, 0)::int as links, l.first_link, null::varchar as data_parts, null::varchar as script, null::varchar as state
        from pages p left join titles using (page_id) left join (select page_id, count(*) as links, arg_min(url, pos) as first_link from links group by all) l using (page_id)
        union all select -1 - p_partkey, case when p_partkey % 8 <> 0 then 'url,status,meta,data,outline' else 'url,status,data,outline' end, 0, null, case when p_partkey % 8 <> 0 then 'jsonld,json_scripts,state' else 'json_scripts,state' end,
          p_partkey::varchar, p_size::varchar from part""",
        t.LINKS,
    ),
)
def page_documents(spark, root):
    """Whole documents of stored pages and of pages with embedded data (negative ids): which parts they have, and values out of them."""
    made = fixtures.embedded_pages(spark, root).withColumn("page_id", -1 - F.col("page_id")).withColumn("requested_url", F.col("url"))
    made = made.select("page_id", "url", "requested_url", F.lit(200).alias("status"), "html")
    stored = responses.pages(spark, root).select("page_id", "url", "requested_url", "status", "html")
    docs = jobs.page_document(stored.unionByName(made))
    links = F.from_json(F.get_json_object("doc", "$.links"), "array<struct<url:string>>")
    return docs.select(
        "page_id", F.array_join(F.json_object_keys("doc"), ",").alias("parts"), F.coalesce(F.size(links), F.lit(0)).alias("links"), F.get(links, F.lit(0))["url"].alias("first_link"),
        F.array_join(F.json_object_keys(F.get_json_object("doc", "$.data")), ",").alias("data_parts"),
        F.get_json_object("doc", "$.data.json_scripts.__NEXT_DATA__.k").alias("script"), F.get_json_object("doc", "$.data.state.__STATE_A__.size").alias("state"),
    )


@query(
    "listing_cards",
    """select 'https://jobs.example.com/list/' || (s_suppkey // 50) as _url, row_number() over (partition by s_suppkey // 50 order by s_suppkey) as _row, s_name as position,
      'Nation ' || s_nationkey as company, 'L' || s_suppkey as location, '2024-01-02' as date,
      case when s_suppkey % 3 <> 0 then 'https://jobs.example.com/jobs/' || s_suppkey || '?a=1&b=2' end as url, null::varchar as asin, null::varchar as title, null::varchar as price, null::varchar as rating from supplier
    union all select 'https://shop.example.com/list/' || (p_partkey // 50), row_number() over (partition by p_partkey // 50 order by p_partkey), null, null, null, null, null,
      'A' || p_partkey, p_name, p_size || ' €', null from part""",
)
def listing_cards(spark, root):
    """Job cards and search results in one table, each page read by the rules of its kind."""
    pages = fixtures.card_pages(spark, root)
    answers = pages.withColumn("final_url", F.col("url")).withColumn("problem", F.lit(None).cast("struct<kind:string,reason:string>"))
    rows = jobs.extract_table(answers, F.col("kind"), {"jobs": rulesets.JOB_CARDS, "shop": rulesets.MARKET_SEARCH})
    return rows


#: Rule sets of five kinds of pages.
KINDS = {
    "jobs": rulesets.JOB_CARDS, "shop": rulesets.MARKET_SEARCH, "product": rulesets.MARKET_PRODUCT,
    "nav": jobs.RuleSet(fields=(Field("name", Pick(((Step(tag="a"),),))),), each=((Step(tag="nav"), Step(tag="li")),)),
    "article": jobs.RuleSet(fields=(Field("heading", Pick(((Step(tag="h1"),),))), Field("asin", Pick(((Step(id="ASIN"),),), "attr:value")))),
}
_NONE = "null::varchar"


def _wide(**given: str) -> str:
    names = "position company location date url asin title price rating reviews brand bullets image name heading".split()
    return ", ".join(f"{given.get(n, _NONE)} as {n}" for n in names)


@query(
    "rule_tables",
    t.page_sql(
        f"""select 'https://jobs.example.com/list/' || (s_suppkey // 50) as _url, row_number() over (partition by s_suppkey // 50 order by s_suppkey)::varchar as _row, {_wide(
            position="s_name", company="'Nation ' || s_nationkey", location="'L' || s_suppkey", date="'2024-01-02'",
            url="case when s_suppkey % 3 <> 0 then 'https://jobs.example.com/jobs/' || s_suppkey || '?a=1&b=2' end")} from supplier
        union all select 'https://shop.example.com/list/' || (p_partkey // 50), row_number() over (partition by p_partkey // 50 order by p_partkey)::varchar, {_wide(
            asin="'A' || p_partkey", title="p_name", price="p_size || ' €'")} from part
        union all select 'https://shop.example.com/dp/' || p_partkey, '1', {_wide(
            title="p_name", price="p_size || ' €'", rating="'4.' || (p_size % 10) || ' of 5'", brand="p_brand", bullets="p_brand || '; ' || p_type",
            image="case when p_partkey % 4 <> 0 then 'https://shop.example.com/i/' || p_partkey || '.jpg' end", asin="'A' || p_partkey")} from part
        union all select p.url, row_number() over (partition by n.page_id order by n.pos)::varchar, {_wide(name=t.clean("s.text"))}
          from nodes n join pages p using (page_id) join nodes a on a.page_id = n.page_id and a.parent = n.pos and a.tag = 'a' join subtext s on s.page_id = a.page_id and s.pos = a.pos
          where n.tag = 'li' and p.page_id % 2 = 0
        union all select p.url, '1', {_wide(heading="(select arg_min(" + t.clean("s.text") + ", s.pos) from nodes h join subtext s on s.page_id = h.page_id and s.pos = h.pos where h.page_id = p.page_id and h.tag = 'h1')")}
          from pages p where page_id % 2 = 1""",
    ),
)
def rule_tables(spark, root):
    """Five kinds of pages read by five rule sets in one pass, written as a CSV feed and read back."""
    stored = responses.pages(spark, root).select(F.when(F.col("page_id") % 2 == 0, "nav").otherwise("article").alias("kind"), "url", "requested_url", "status", "html")
    pages = fixtures.card_pages(spark, root).unionByName(fixtures.product_pages(spark, root)).unionByName(stored)
    answers = pages.withColumn("final_url", F.col("url")).withColumn("problem", F.lit(None).cast("struct<kind:string,reason:string>"))
    rows = jobs.extract_table(answers, F.col("kind"), KINDS)
    path = fresh_path(spark, "csv")
    sinks.write_csv(rows, path)
    return responses.csv_feed(spark, path, rows.columns)


NAV = jobs.RuleSet(fields=(Field("name", Pick(((Step(tag="a"),),))),), each=((Step(tag="nav"), Step(tag="li")),))


@query(
    "batch_index",
    t.page_sql(
        """select url, pos, outcome, rows, reason from (
          select p.url, p.page_id * 2 as pos, case when page_id % 11 = 0 then 'FAILED' else 'ok' end as outcome,
            case when page_id % 11 = 0 then 0 else (select count(*) from nodes n where n.page_id = p.page_id and n.tag = 'li') end as rows,
            case when page_id % 11 = 0 then 'HTTP 503' else '' end as reason from pages p
          union all select 'https://missing.example.com/' || page_id, page_id * 2 + 1, 'FAILED', 0, 'nothing is stored' from pages where page_id % 10 = 0)"""
    ),
)
def batch_index(spark, root):
    """A URL list against stored answers: what each URL gave, or why it gave nothing."""
    p = responses.pages(spark, root).withColumn("status", F.when(F.col("page_id") % 11 == 0, 503).otherwise(F.col("status")))
    ids = table(spark, root, "pages").select("page_id", "url")
    wanted = ids.select("url", (F.col("page_id") * 2).alias("pos")).unionByName(
        ids.filter(F.col("page_id") % 10 == 0).select(
            F.concat(F.lit("https://missing.example.com/"), F.col("page_id").cast("string")).alias("url"), (F.col("page_id") * 2 + 1).alias("pos")))
    answers = jobs.fetched(wanted, p)
    rows = jobs.extract_table(answers, F.lit("nav"), {"nav": NAV})
    return jobs.batch_index(answers, rows)


@query(
    "site_corpus",
    f"with recursive {_REACH}, {t.PAGES.strip()}, {_FOCUS}, {_MARKDOWN} select domain, split_part(p.url, '#', 1) as url, b.depth, coalesce(title, '') as title, markdown "
    "from best b join pages p on split_part(p.url, '#', 1) = b.url join md using (page_id) left join titles using (page_id)",
)
def site_corpus(spark, root):
    """Crawl of each domain over stored pages, to Markdown records."""
    starts, links, rules = _crawl(spark, root)
    return jobs.site_corpus(starts, links, responses.pages(spark, root), deny=["/de/9"], rules=rules)
