"""Queries over the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from weblode.catalog import query
from weblode.catalog import twins as t
from weblode.catalog.pages import _FOCUS, doms
from weblode.functions import text, urls
from weblode.functions.headers import file_extension, media_type
from weblode.operators import corpus, extract
from weblode.sources import fixtures, responses
from weblode.sources.responses import spread, table


@query(
    "contacts",
    """select email, count(distinct doc_id) as documents from (
      select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}')) as email from documents) group by email""",
)
def contacts(spark, root):
    """Addresses in the corpus; distinct per document before anything is shuffled."""
    found = spread(table(spark, root, "documents")).select("doc_id", F.explode(text.emails("text")).alias("email"))
    return found.groupBy("email").agg(F.count("*").alias("documents"))


_TERMS = ("the", "mail", "que")


@query(
    "corpus_search",
    f"""with w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as ws from documents),
    c as (select doc_id, len(ws) as n, {", ".join(f"len(list_filter(ws, lambda x: x = '{x}')) as tf{i}" for i, x in enumerate(_TERMS))} from w),
    s as (select count(*) as docs, avg(n) as mean, {", ".join(f"count(*) filter (tf{i} > 0) as df{i}" for i in range(len(_TERMS)))} from c)
    select doc_id, round(0.0 + {" + ".join(f"ln(1 + (docs - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2::double / (tf{i} + 1.2::double * (1 - 0.75::double + 0.75::double * n / mean))" for i in range(len(_TERMS)))}, 6) as score
    from c cross join s where {" or ".join(f"tf{i} > 0" for i in range(len(_TERMS)))} order by score desc, doc_id limit 20""",
)
def corpus_search(spark, root):
    return corpus.search(spread(table(spark, root, "documents")), _TERMS, top=20)


@query(
    "corpus_index",
    t.page_sql(
        f"""select coalesce(d, '') as domain, coalesce(h, '') as host, count(*) as pages, sum(length(body))::bigint as characters from (
          select regexp_extract({t.host('p.url')}, '([^.]+\\.[^.]+)$', 1) as d, {t.host('p.url')} as h,
            (select coalesce(string_agg(x.text, chr(10) order by x.pos), '') from txt x where x.page_id = f.page_id and x.text <> '' and (f.pos is null or (n.pos < x.pos and x.pos < n.fin))) as body
          from focus f join pages p on p.page_id = f.page_id left join nodes n on n.page_id = f.page_id and n.pos = f.pos) group by rollup (d, h)""",
        _FOCUS,
    ),
)
def corpus_index(spark, root):
    d = extract.with_focus(doms(spark, root)).select("url", F.length(extract.visible_text(F.col("focus.pos"))).alias("n"))
    host = urls.host("url")
    out = corpus.sizes(d, F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), host, F.col("n"))
    return out.select(F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("host", F.lit("")).alias("host"), "pages", "characters")


_LINES = f"""
rec as (select doc_id * 2 as line_no, 'https://' || source || '.example.com/' || doc_id as url, 'Doc ' || doc_id as title, text as markdown from documents where doc_id % 33 not in (5, 6)
  union all select doc_id * 2 + 1, 'https://' || source || '.example.com/' || doc_id, 'Doc ' || doc_id, 'v2 ' || text from documents where doc_id % 20 = 0)
"""


@query("corpus_compact", f"with {_LINES} select url, min(line_no) as first_seen, arg_max(title, line_no) as title, arg_max(markdown, line_no) as markdown from rec group by url")
def corpus_compact(spark, root):
    records = responses.json_lines(fixtures.corpus_lines(spark, root), "url string, title string, markdown string", "url")
    return corpus.compact(records)


@query(
    "corpus_listing",
    f"""with {_LINES}, c as (select url, min(line_no) as first_seen, arg_max(title, line_no) as title, arg_max(markdown, line_no) as markdown from rec group by url)
    select first_seen, '- [' || title || '](' || url || ') · ' || format('{{:,}}', length(markdown)) || ' characters' as line from c""",
)
def corpus_listing(spark, root):
    records = responses.json_lines(fixtures.corpus_lines(spark, root), "url string, title string, markdown string", "url")
    c = corpus.compact(records)
    return c.select("first_seen", corpus.index_line(F.col("title"), F.col("url"), F.coalesce("markdown", F.lit(""))).alias("line"))


@query(
    "previews",
    "select doc_id, case when length(text) > 1000 then rtrim(left(text, 1000), ' ') else text end as preview, length(text) > 1000 as was_cut from documents",
)
def previews(spark, root):
    return table(spark, root, "documents").select("doc_id", *corpus.preview(F.col("text"), 1000))


@query(
    "body_kinds",
    """select page_id, ['html', 'json', 'feed', 'xml', 'text', 'binary', 'binary', 'html'][page_id % 8 + 1] as kind,
    ['text/html', 'application/json', 'application/xml', 'text/xml', 'text/plain', 'application/pdf', 'application/vnd.x-y+zip', ''][page_id % 8 + 1] as media,
    case page_id % 8 when 5 then 'pdf' when 6 then 'vndxy' end as extension from pages""",
)
def body_kinds(spark, root):
    b = fixtures.bodies(spark, root).select(
        "page_id", "body", media_type(F.create_map(F.lit("content-TYPE"), "content_type")).alias("media"))
    kind = corpus.body_kind(F.col("media"), F.col("body"))
    return b.select("page_id", kind.alias("kind"), "media", F.when(kind == "binary", file_extension("media")).alias("extension"))


@query(
    "merged_rows",
    """select 'https://' || source || '.example.com/' || doc_id as _url, lang as lang, null::varchar as host, lang || '; ' || source as tags from documents
    union all select url, null, regexp_extract(url, '^https?://([^/?#]*)', 1), null from pages""",
)
def merged_rows(spark, root):
    """Rows of two rule sets in one CSV-ready table: columns are united, lists joined."""
    a = table(spark, root, "documents").select(
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), F.col("doc_id").cast("string")).alias("_url"), "lang", F.array("lang", "source").alias("tags"))
    b = table(spark, root, "pages").select(F.col("url").alias("_url"), urls.netloc("url").alias("host"))
    return corpus.csv_ready(corpus.merge_rows([a, b]))
