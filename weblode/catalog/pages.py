"""Queries over stored pages: every one runs on the node arrays of whole pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from weblode.catalog import query
from weblode.catalog import twins as t
from weblode.catalog.twins import page_sql
from weblode.functions import urls
from weblode.functions.text import clean, let
from weblode.operators import dom, extract, relocate
from weblode.operators.select import Field, Pick, Step, extract_rows, select, values
from weblode.sources import responses


def doms(spark, root):
    return dom.with_nodes(responses.pages(spark, root))


@query(
    "page_titles",
    page_sql("select p.page_id, p.url, coalesce(title, '') as title from pages p left join titles using (page_id)"),
)
def page_titles(spark, root):
    return doms(spark, root).select("page_id", "url", dom.page_title().alias("title"))


@query("page_links", page_sql("select page_id, pos, text, url, same_site from links", t.LINKS))
def page_links(spark, root):
    return extract.links(doms(spark, root))


@query(
    "host_link_graph",
    page_sql(
        f"""select {t.host('page_url')} as source_host, {t.host('url')} as target_host, count(*) as links,
        count(distinct page_id) as pages from links group by all""",
        t.LINKS,
    ),
)
def host_link_graph(spark, root):
    """Links between hosts: counted per page in its row, so that only pairs are shuffled."""
    hosts = F.transform(extract.link_array(), lambda x: urls.host(x["url"]))

    def counted(all_):
        return F.transform(
            F.array_distinct(all_), lambda h: F.struct(h.alias("target_host"), F.size(F.filter(all_, lambda o: o == h)).alias("n")))

    per_page = doms(spark, root).select(urls.host("url").alias("source_host"), F.inline(let(hosts, counted)))
    return per_page.groupBy("source_host", "target_host").agg(F.sum("n").alias("links"), F.count("*").alias("pages"))


@query(
    "dom_tag_profile",
    page_sql(
        """select tag, coalesce(parent_tag, '') as parent_tag, depth, count(*) as elements, sum(fin - pos) as tokens
        from nodes group by all"""
    ),
)
def dom_tag_profile(spark, root):
    # The parent is in the same array, so its tag is looked up in place.
    shaped = F.transform(
        F.filter("nodes", dom.is_element),
        lambda n: F.struct(
            n["tag"].alias("tag"), F.coalesce(F.get(F.col("nodes"), n["parent"])["tag"], F.lit("")).alias("parent_tag"),
            n["depth"].alias("depth"), (n["end"] - n["pos"]).alias("span"),
        ),
    )
    rows = doms(spark, root).select(F.inline(shaped))
    return rows.groupBy("tag", "parent_tag", "depth").agg(F.count("*").alias("elements"), F.sum("span").alias("tokens"))


NAV_LINK = (Step(tag="nav"), Step(tag="li"), Step(tag="a", attrs=(("href", "has", None),), child=True))


@query(
    "select_nav_items",
    page_sql(
        f"""select a.page_id, a.pos, {t.clean('s.text')} as text,
          {t.scheme('p.url')} || '://' || {t.netloc('p.url')} || {t.HREF.replace('raw', 'a.raw')} as url
        from nodes a join subtext s using (page_id, pos) join pages p on p.page_id = a.page_id
        where a.tag = 'a' and a.parent_tag = 'li'
          and exists (from nodes n where n.page_id = a.page_id and n.tag = 'nav' and n.pos < a.pos and a.pos < n.fin)"""
    ),
)
def select_nav_items(spark, root):
    nodes = F.col("nodes")
    found = F.transform(
        select(nodes, NAV_LINK),
        lambda n: F.struct(
            n["pos"].alias("pos"), clean(F.array_join(dom.own_texts(nodes, n), " ")).alias("text"),
            urls.resolve(F.col("url"), dom.attribute(n, "href")).alias("href"),
        ),
    )
    d = doms(spark, root).select("page_id", F.inline(found))
    return d.select("page_id", "pos", "text", F.col("href").alias("url"))


@query(
    "row_rules_nav",
    page_sql(
        f"""select page_id, page_url as _url, _row, name, href, words from (
          select a.page_id, p.url as page_url, row_number() over (partition by a.page_id order by a.pos) as _row,
            {t.clean('s.text')} as name,
            {t.scheme('p.url')} || '://' || {t.netloc('p.url')} || {t.HREF.replace('raw', 'a.raw')} as href,
            {t.clean('s.text')} as words
          from nodes a join subtext s using (page_id, pos) join pages p on p.page_id = a.page_id
          where a.tag = 'a' and a.parent_tag = 'li') where _row <= 3"""
    ),
)
def row_rules_nav(spark, root):
    link = (Step(tag="a"),)
    rows = extract_rows(
        doms(spark, root),
        [
            Field("name", Pick((link,), "own")),
            Field("href", Pick((link,), "attr:href")),
            Field("words", Pick((link,), "text"), many=True),
        ],
        each=[(Step(tag="nav"), Step(tag="li"))],
        keep=("page_id", "url"),
        limit=3,
    )
    return rows.select("page_id", F.col("url").alias("_url"), "_row", "name", "href", F.array_join("words", "; ").alias("words"))


@query(
    "page_rows",
    page_sql(
        f"""select p.page_id, coalesce(nullif(title, ''), null) as title, null::varchar as missing, m.n as ads, h.text as heading
        from pages p left join titles using (page_id)
        left join (select n.page_id, arg_min({t.clean('s.text')}, n.pos) as text from nodes n join subtext s using (page_id, pos)
                   where n.tag = 'h1' and s.text <> '' group by all) h on h.page_id = p.page_id
        left join (select n.page_id, string_agg({t.clean('s.text')}, '; ' order by n.pos) as n from nodes n join subtext s using (page_id, pos)
                   where n.tag = 'div' and contains(n.raw, 'class="ad"') and s.text <> '' group by all) m on m.page_id = p.page_id"""
    ),
)
def page_rows(spark, root):
    """One row per page when no row selector is given."""
    rows = extract_rows(
        doms(spark, root),
        [
            Field("title", Pick(((Step(tag="title"),),), "own")),
            Field("missing", Pick(((Step(classes=("nope",)),),), "own")),
            Field("heading", Pick(((Step(tag="h1"),),))),
            Field("ads", Pick(((Step(tag="div", classes=("ad",)),),)), many=True),
        ],
        keep=("page_id",),
    )
    return rows.select("page_id", "title", "missing", "heading", F.nullif(F.array_join("ads", "; "), F.lit("")).alias("ads"))


@query(
    "selector_values",
    page_sql(
        f"""select n.page_id, row_number() over (partition by n.page_id order by x.pos) as pos, {t.clean(t.unescape('x.raw'))} as value
        from nodes n join tk x on x.page_id = n.page_id and x.kind = 'text' and n.pos < x.pos and x.pos < n.fin
        where n.tag in ('h1', 'footer') and {t.clean(t.unescape('x.raw'))} <> ''"""
    ),
)
def selector_values(spark, root):
    got = values("nodes", Pick(((Step(tag="h1"),), (Step(tag="footer"),)), "own"), "url")
    d = doms(spark, root).select("page_id", F.posexplode(got).alias("pos", "value"))
    return d.select("page_id", (F.col("pos") + 1).alias("pos"), "value")


@query(
    "selected_html",
    page_sql(
        """select n.page_id, n.pos, string_agg(x.raw, '' order by x.pos) as html
        from nodes n join tk x on x.page_id = n.page_id and n.pos <= x.pos and x.pos <= n.fin
        where n.tag in ('nav', 'footer') group by all"""
    ),
)
def selected_html(spark, root):
    nodes = F.col("nodes")
    from weblode.operators.select import select_any

    found = F.transform(
        select_any(nodes, [(Step(tag="nav"),), (Step(tag="footer"),)]),
        lambda n: F.struct(n["pos"].alias("pos"), dom.outer_html(nodes, n).alias("html")),
    )
    return doms(spark, root).select("page_id", F.inline(found))


@query(
    "find_by_text",
    page_sql(
        """select n.page_id, n.pos, n.tag, o.text from nodes n join own_text o using (page_id, pos) join titles using (page_id)
        where n.kind = 'open' and title <> '' and o.text = title""",
        f"""
owner as (
  select x.page_id, x.pos, any_value(x.raw) as raw, max(n.pos) as parent from tk x
  join nodes n on n.page_id = x.page_id and n.kind = 'open' and n.pos < x.pos and x.pos < n.fin where x.kind = 'text' group by all),
own_text as (select page_id, parent as pos, {t.clean(f"string_agg({t.unescape('raw')}, ' ' order by pos)")} as text from owner group by page_id, parent)
""",
    ),
)
def find_by_text(spark, root):
    """Elements whose own text equals the page title."""
    return extract.find_by_text(doms(spark, root), dom.page_title())


@query(
    "find_similar",
    page_sql(
        """select n.page_id, n.pos, n.tag, n.depth, n.parent_tag from nodes n
        where n.tag = 'li' and exists (from nodes f where f.page_id = n.page_id and f.tag = 'li' and f.depth = n.depth
              and f.parent_tag = n.parent_tag and f.pos = (select min(pos) from nodes m where m.page_id = n.page_id and m.tag = 'li'))"""
    ),
)
def find_similar(spark, root):
    """List items built like the first one of the page."""
    first = F.slice(select("nodes", [Step(tag="li")]), 1, 1)
    return extract.find_similar(doms(spark, root), first)


@query(
    "page_meta",
    page_sql(
        f"""select p.page_id, p.url, 200 as status, nullif(title, '') as title, null::varchar as description, null::varchar as canonical,
          l.lang, h.h1, 0 as social_tags, 0 as feeds, 0 as jsonld
        from pages p left join titles using (page_id)
        left join (select page_id, nullif(regexp_extract(raw, 'lang="([^"]*)"', 1), '') as lang from nodes where tag = 'html') l on l.page_id = p.page_id
        left join (select n.page_id, string_agg({t.clean('s.text')}, '; ' order by n.pos) as h1 from nodes n join subtext s using (page_id, pos)
                   where n.tag = 'h1' group by all) h on h.page_id = p.page_id"""
    ),
)
def page_meta(spark, root):
    m = extract.metadata(doms(spark, root))
    return m.select(
        "page_id", "url", "status", "title", "description", "canonical", "lang", F.array_join("h1", "; ").alias("h1"),
        F.size("social").alias("social_tags"), F.size("feeds").alias("feeds"), F.size("jsonld").alias("jsonld"),
    )


_FOCUS = """
total as (select page_id, length(coalesce(string_agg(text, chr(10) order by pos), '')) as text_len from txt where text <> '' group by page_id),
cand as (
  select n.page_id, count(*) as hits, any_value(n.pos) as pos, any_value(length(s.text)) as kept
  from nodes n join subtext s using (page_id, pos) where n.tag = 'article' group by n.page_id),
focus as (
  select p.page_id, coalesce(t.text_len, 0) as text_len,
         case when t.text_len >= 400 and c.hits = 1 and c.kept >= 0.5 * t.text_len then 'article' end as rule,
         case when t.text_len >= 400 and c.hits = 1 and c.kept >= 0.5 * t.text_len then c.pos end as pos
  from pages p left join total t using (page_id) left join cand c on c.page_id = p.page_id)
"""


@query("page_focus", page_sql("select page_id, text_len, rule from focus", _FOCUS))
def page_focus(spark, root):
    return extract.with_focus(doms(spark, root)).select("page_id", "text_len", F.col("focus.rule").alias("rule"))


@query(
    "page_text",
    page_sql(
        f"""select f.page_id, coalesce(string_agg(replace(x.text, chr(8203), ''), chr(10) order by x.pos), '') as text
        from focus f left join nodes n on n.page_id = f.page_id and n.pos = f.pos
        left join txt x on x.page_id = f.page_id and x.text <> '' and (f.pos is null or (n.pos < x.pos and x.pos < n.fin))
        group by all""",
        _FOCUS,
    ),
)
def page_text(spark, root):
    d = extract.with_focus(doms(spark, root))
    return d.select("page_id", extract.visible_text(F.col("focus.pos")).alias("text"))


_MD_OPEN = f"""case when tag = '' then regexp_replace({t.unescape('raw')}, '[\\s\\x{{a0}}]+', ' ', 'g')
  when tag = 'h1' then chr(10) || chr(10) || '# ' when tag = 'b' then '**' when tag = 'br' then chr(10)
  when tag = 'li' then chr(10) || '- ' when tag = 'a' then '['
  when tag in ('p', 'div', 'article', 'nav', 'ul', 'footer', 'body') then chr(10) || chr(10) else '' end"""
_MARKDOWN = f"""
scope as (
  select f.page_id, p.url, coalesce(n.pos, 0) as lo, coalesce(n.fin, z.n) as hi
  from focus f join pages p on p.page_id = f.page_id left join nodes n on n.page_id = f.page_id and n.pos = f.pos
  join (select page_id, max(pos) + 1 as n from tk group by page_id) z on z.page_id = f.page_id),
shown as (
  select page_id, pos, pos + 1 as fin, '' as tag, raw from tk where kind = 'text'
  union all select page_id, pos, fin, tag, raw from nodes where kind in ('open', 'leaf')),
pieces as (
  select s.page_id, s.pos, 1 as rank, 0 as ord, {_MD_OPEN} as text
  from shown s join scope c on c.page_id = s.page_id and s.pos >= c.lo and s.pos < c.hi where tag not in ('head', 'title', 'meta')
  union all
  select s.page_id, least(s.fin, c.hi), 0, -s.pos,
    case when tag = 'h1' then chr(10) || chr(10) when tag = 'b' then '**'
         when tag = 'a' then '](' || {t.scheme('c.url')} || '://' || {t.netloc('c.url')} || {t.HREF} || ')'
         when tag in ('p', 'div', 'article', 'nav', 'ul', 'footer', 'body') then chr(10) || chr(10) else '' end
  from shown s join scope c on c.page_id = s.page_id and s.pos >= c.lo and s.pos < c.hi),
md as (
  select page_id, {t.strip("regexp_replace(regexp_replace(regexp_replace(string_agg(text, '' order by pos, rank, ord), chr(10) || '[ ' || chr(9) || ']+', chr(10), 'g'), '[ ' || chr(9) || ']+' || chr(10), chr(10), 'g'), chr(10) || '{3,}', chr(10) || chr(10), 'g')")} || chr(10) as markdown
  from pieces where text <> '' and not exists (from nodes h where h.page_id = pieces.page_id and h.tag = 'head' and h.pos < pieces.pos and pieces.pos < h.fin and rank = -1)
  group by page_id)
"""


@query(
    "page_markdown",
    page_sql(
        """select page_id, url, 200 as status, coalesce(title, '') as title, rule as focus, markdown
        from pages p join focus using (page_id) join md using (page_id) left join titles using (page_id)""",
        _FOCUS + "," + _MARKDOWN,
    ),
)
def page_markdown(spark, root):
    return extract.documents(doms(spark, root)).select("page_id", "url", "status", "title", "focus", "markdown")


_OUTLINE = f"""
el as (
  select n.page_id, n.pos, n.fin, n.parent, n.depth - b.depth as lvl, b.pos as root_pos, s.text as raw_text, n.tag
     || coalesce('#' || nullif(regexp_extract(n.raw, '\\sid="([^"]*)"', 1), ''), '')
     || coalesce('.' || nullif(regexp_extract(n.raw, 'class="([^"]*)"', 1), ''), '') as sig,
     {t.clean('s.text')} as text,
     exists (from nodes k where k.page_id = n.page_id and k.parent = n.pos) as has_child
  from nodes n join (select page_id, min(pos) as pos, min(fin) as fin, min(depth) as depth from nodes where tag = 'body' group by page_id) b
    on b.page_id = n.page_id and n.pos >= b.pos and n.pos < b.fin
  join subtext s on s.page_id = n.page_id and s.pos = n.pos
  where n.tag not in ('script', 'style', 'link', 'meta', 'br', 'hr') and n.depth <= b.depth + 6),
grp as (select *, count(*) over w as times, row_number() over (partition by page_id, parent, sig order by pos) as nth
        from el window w as (partition by page_id, parent, sig)),
vis as (select g.*, row_number() over (partition by page_id order by pos) as line from grp g
        where not exists (from grp r where r.page_id = g.page_id and r.nth > 1 and r.pos <= g.pos and g.pos < r.fin))
"""


@query(
    "page_outline",
    page_sql(
        """select v.page_id, v.line, v.lvl as depth, case when v.lvl = 0 then v.sig else
          repeat('  ', v.lvl::int) || v.sig || case when v.times > 1 then ' ×' || v.times else '' end || ' (' || length(v.text) || ')'
          || case when not v.has_child and v.text <> '' then ' “' || left(v.text, 50) || '”' else '' end end as text
        from vis v left join vis p on p.page_id = v.page_id and p.pos = v.parent
        where v.lvl = 0 or p.line < 400""",
        _OUTLINE,
    ),
)
def page_outline(spark, root):
    return extract.outline(doms(spark, root))


@query(
    "page_json",
    page_sql(
        """select page_id, to_json({'url': url, 'status': 200, 'title': coalesce(title, ''), 'markdown': markdown})::varchar as doc
        from pages p join focus using (page_id) join md using (page_id) left join titles using (page_id)""",
        _FOCUS + "," + _MARKDOWN,
    ),
)
def page_json(spark, root):
    """The JSON document of a page, its Markdown included."""
    return extract.documents(doms(spark, root)).select("page_id", F.to_json(F.struct("url", "status", "title", "markdown")).alias("doc"))


@query("relocated_headings", page_sql("select page_id, 'heading' as name, pos + 1 as pos from nodes where tag = 'h1'"))
def relocated_headings(spark, root):
    """Main headings remembered from the stored pages, found again after a redesign put them one element deeper."""
    pages = responses.pages(spark, root)
    saved = relocate.fingerprints(dom.with_nodes(pages), select("nodes", [Step(tag="h1")]), ["page_id"], F.lit("heading"))
    redesigned = F.replace(F.replace("html", F.lit("<article>"), F.lit('<main><article class="v2">')), F.lit("<h1>"), F.lit('<h1 class="big">'))
    now = relocate.candidates(dom.with_nodes(pages.withColumn("html", redesigned)), ["page_id"])
    return relocate.relocate(saved, now, ["page_id"], threshold=0.3).select("page_id", "name", "pos")
