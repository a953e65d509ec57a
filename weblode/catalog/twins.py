"""SQL fragments the twins share (DuckDB dialect).

The page fragment computes the node table with windows and interval joins,
a different way from the engine's, so that equal results mean something.
"""

from __future__ import annotations

from weblode.functions.text import WHITESPACE

WS = WHITESPACE


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def unescape(x: str) -> str:
    out = x
    for name, char in (("copy", "©"), ("middot", "·"), ("nbsp", " "), ("quot", '"'), ("#39", "''"), ("lt", "<"), ("gt", ">")):
        out = f"replace({out}, '&{name};', '{char}')"
    # Last, and as browsers and Python do, also where the semicolon is missing.
    return f"regexp_replace({out}, '&amp;?', '&', 'g')"


_S = "[a-zA-Z][a-zA-Z0-9+.-]*"


def scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, '^({_S}):', 1))"


def netloc(u: str) -> str:
    return f"regexp_extract({u}, '^(?:{_S}:)?//([^/?#]*)', 1)"


def path(u: str) -> str:
    return f"regexp_extract({u}, '^(?:{_S}:)?(?://[^/?#]*)?([^?#]*)', 1)"


def url_query(u: str) -> str:
    return f"regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"


def host(u: str) -> str:
    return f"lower(split_part(regexp_extract({netloc(u)}, '([^@]*)$', 1), ':', 1))"


def site(u: str) -> str:
    return f"regexp_replace({host(u)}, '^www\\.', '')"


def on_site(h: str, s: str) -> str:
    return f"({h} = {s} or ends_with({h}, '.' || {s}))"


_TOKEN = (
    r"(?is)<!--.*?-->|"
    + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in ("script", "style", "noscript", "svg", "template", "iframe"))
    + r"""|</?[a-z][^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>|</?[a-z][^>]*>|<[!?][^>]*>|[^<]+|<"""
)

PAGES = f"""
lexed as (select page_id, url, regexp_extract_all(html, {q(_TOKEN)}) as t from pages),
tok0 as (select page_id, url, unnest(range(len(t))) as pos, unnest(t) as raw, len(t) as n from lexed),
tok as (
  select *, case when starts_with(raw, '<') then lower(regexp_extract(raw, '^</?([a-zA-Z][^\\s/>]*)', 1)) else '' end as tag
  from tok0),
tk as (
  select *, case when tag = '' and (not starts_with(raw, '<') or raw = '<') then 'text'
                 when tag = '' then 'other'
                 when starts_with(raw, '</') then 'close'
                 when tag in ('br', 'meta', 'hr', 'img', 'link', 'input') then 'leaf'
                 when tag in ('script', 'style') then 'raw' else 'open' end as kind
  from tok),
txt as (select page_id, pos, {strip(unescape('raw'))} as text from tk where kind = 'text'),
lev as (
  select *, sum(case kind when 'open' then 1 when 'close' then -1 else 0 end)
              over (partition by page_id, tag order by pos) + (case kind when 'close' then 1 else 0 end) as lvl,
         min(case when kind in ('open', 'close') and tag not in ('a', 'b', 'i') then pos end)
              over (partition by page_id order by pos rows between 1 following and unbounded following) as next_block
  from tk),
own as (
  select *, case when kind <> 'open' then pos + 1 when tag = 'p' then next_block
                 else lead(pos) over (partition by page_id, tag, lvl, kind in ('open', 'close') order by pos) end as own_end
  from lev),
clipped as (
  select a.page_id, a.pos, a.tag, a.kind, a.raw, a.n,
         least(coalesce(a.own_end, a.n), coalesce(min(b.own_end), a.n)) as fin
  from own a left join own b on b.page_id = a.page_id and b.kind = 'open' and b.tag not in ('a', 'b', 'i')
       and b.own_end is not null and b.pos < a.pos and a.pos < b.own_end
  where a.kind in ('open', 'leaf', 'raw')
  group by a.page_id, a.pos, a.tag, a.kind, a.raw, a.n, a.own_end),
nodes as (
  select c.page_id, c.pos, c.fin, c.tag, c.kind, c.raw,
         count(p.pos) as depth, coalesce(max(p.pos), -1) as parent, arg_max(p.tag, p.pos) as parent_tag
  from (select page_id, pos, tag, kind, raw, min(fin) as fin from clipped group by all) c
  left join clipped p on p.page_id = c.page_id and p.kind = 'open' and p.pos < c.pos and c.pos < p.fin
  group by all),
subtext as (
  select n.page_id, n.pos, coalesce(string_agg(x.text, chr(10) order by x.pos), '') as text
  from nodes n left join txt x on x.page_id = n.page_id and n.pos < x.pos and x.pos < n.fin and x.text <> ''
  group by all),
titles as (
  select page_id, coalesce(arg_min({clean('t.text')}, t.pos), '') as title
  from (select n.page_id, x.pos, {unescape('x.raw')} as text from nodes n join tk x on x.page_id = n.page_id and x.kind = 'text'
        and n.tag = 'title' and n.pos < x.pos and x.pos < n.fin) t
  group by page_id)
"""


def page_sql(body: str, more: str = "", before: str = "", source: str = "pages") -> str:
    """The page fragment over a table of (page_id, url, html), then the query."""
    fragment = PAGES.strip().replace("from pages)", f"from {source})")
    return "with " + before + fragment + (("," + more) if more else "") + "\n" + body


HREF = "regexp_extract(raw, 'href=\"([^\"]*)\"', 1)"

LINKS = f"""
anchors as (
  select n.page_id, n.pos, n.raw, left({clean('s.text')}, 120) as text,
         split_part({scheme('p.url')} || '://' || {netloc('p.url')} || {HREF.replace('raw', 'n.raw')}, '#', 1) as url,
         p.url as page_url
  from nodes n join subtext s using (page_id, pos) join pages p on p.page_id = n.page_id
  where n.tag = 'a'),
links as (
  select page_id, min(pos) as pos, arg_min(text, pos) as text, url,
         {on_site(host('url'), site('any_value(page_url)'))} as same_site, any_value(page_url) as page_url
  from anchors group by page_id, url)
"""
