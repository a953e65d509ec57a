"""Queries over fetch attempts and page verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weblode.catalog import query
from weblode.catalog import twins as t
from weblode.operators import ordered, verdict
from weblode.operators.select import Step
from weblode.sources import fixtures
from weblode.sources.responses import table

ATTEMPTS = r"""
att as (
  select *, tier in ('http', 'stealth') as local,
    case when tier in ('http', 'stealth') then
           case when status in (404, 410) then 'notfound' when status >= 400 then 'blocked'
                when media = 'text/html' and regexp_matches(final_path, '(?i)/(login|signin)(/|$)') then 'login' end
         when n_chars < 200 then 'error' end as kind,
    case when tier in ('http', 'stealth') then
           case when status >= 400 then 'HTTP ' || status
                when media = 'text/html' and regexp_matches(final_path, '(?i)/(login|signin)(/|$)') then 'sent to a sign-in page' end
         when n_chars < 200 then 'too little text' end as reason
  from (
    select *, case when event_id % 50 = 0 and status = 200 then '/login/' else '/u/' || fetch_id end as final_path
    from (
      select event_id // 4 as fetch_id, event_id, event_id as attempt_id, ts, 'h' || ((event_id // 4) % 17) || '.example.com' as host,
        (event_id % 4)::int as tier_rank, ['http', 'stealth', 'exa', 'jina'][event_id % 4 + 1] as tier,
        case when event_type in ('view', 'click') then 200 when event_type = 'error' then 403 when event_type = 'signup' then 404 else 401 end as status,
        case when event_id % 7 = 0 then 'application/json' else 'text/html' end as media, floor(value * 20)::int as n_chars
      from events)))
"""

# The ladder by walking ranks with cumulative windows, the way it runs in life.
LADDER = """
walk as (
  select *, coalesce(bool_or(kind in ('notfound', 'login') and local) over prior, false) as stopped,
    coalesce(bool_or(kind is null and used) over prior, false) as solved
  from (select *, local or (coalesce(bool_or(local) over before_me, false) and not coalesce(bool_or(local and status in (401, 407)) over before_me, false)) as used
        from {source}
        window before_me as (partition by fetch_id order by tier_rank rows between unbounded preceding and 1 preceding))
  window prior as (partition by fetch_id order by tier_rank rows between unbounded preceding and 1 preceding)),
seen as (select * from walk where used and not stopped and not solved),
best as (
  select fetch_id, coalesce(arg_min(tier, tier_rank) filter (kind is null), arg_max(tier, tier_rank) filter (local)) as tier,
    case when count(*) filter (kind is null) > 0 then 'ok' else coalesce(arg_max(kind, tier_rank) filter (local), 'error') end as kind,
    case when count(*) filter (kind is null) > 0 then null else coalesce(arg_max(reason, tier_rank) filter (local), 'nothing came back') end as reason,
    coalesce(string_agg(tier || ': ' || reason, ' | ' order by tier_rank) filter (kind is not null), '') as trail
  from seen group by fetch_id)
"""


def _judged(spark, root):
    return verdict.judged(fixtures.attempts(spark, root))


@query(
    "diagnose_attempts",
    f"""with {ATTEMPTS} select host, kind, status_class, attempts, round(attempts / sum(attempts) over (partition by host), 6) as share
    from (select host, coalesce(kind, 'ok') as kind, (status // 100)::int as status_class, count(*) as attempts from att group by all)""",
)
def diagnose_attempts(spark, root):
    return verdict.host_health(_judged(spark, root))


@query(
    "best_attempt",
    f"with {ATTEMPTS}, {LADDER.format(source='att')} select fetch_id, tier, kind, reason, trail from best",
)
def best_attempt(spark, root):
    out = verdict.ladder(_judged(spark, root), ["fetch_id"])
    trail = F.array_join(F.transform("trail", lambda r: F.concat(r["tier"], F.lit(": "), r["reason"])), " | ")
    return out.select("fetch_id", "tier", "kind", "reason", trail.alias("trail"))


@query(
    "next_tier_plan",
    f"""with {ATTEMPTS}, sofar as (select * from att where tier_rank <= fetch_id % 4), {LADDER.format(source='sofar')},
    st as (select fetch_id, max(tier_rank) as reached, bool_or(local and status in (401, 407)) as auth,
                  arg_max(status, tier_rank) filter (local) as last_status, arg_max(tier, tier_rank) filter (local) as last_tier,
                  max(tier_rank) filter (local) = max(tier_rank) as at_local from sofar group by fetch_id)
    select fetch_id, kind, reached, case when kind = 'ok' then 'done' when kind in ('notfound', 'login') then 'stop: ' || kind
        when at_local and last_status = 403 then 'retry: ' || last_tier
        when reached = 3 then 'stop: every tier was tried' when reached = 0 then 'stealth'
        when auth then 'stop: the site asks for authentication' when reached = 1 then 'exa' else 'jina' end as plan
    from best join st using (fetch_id)""",
)
def next_tier_plan(spark, root):
    """Attempts so far: the first one to four tiers of each fetch; a 403 is tried once more."""
    sofar = _judged(spark, root).filter(F.col("tier_rank") <= F.col("fetch_id") % 4)
    return verdict.next_tier(sofar, ["fetch_id"], retry=F.col("status") == 403)


@query(
    "batch_summary",
    f"""with {ATTEMPTS}, {LADDER.format(source='att')},
    s as (select count(*) as requests, count(*) filter (kind in ('notfound', 'error')) as failed, count(*) filter (kind = 'blocked') as blocked,
          count(*) filter (kind = 'login') as behind_login, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 as elapsed_seconds from att)
    select count(*) filter (kind = 'ok') as ok, count(*) as total,
      case when count(*) filter (kind = 'ok') > 0 then 0 when bool_or(kind in ('login', 'blocked')) then 2 else 1 end as level,
      any_value(requests) as requests, any_value(failed) as failed, any_value(blocked) as blocked,
      any_value(behind_login) as behind_login, any_value(elapsed_seconds) as elapsed_seconds from best cross join s""",
)
def batch_summary(spark, root):
    judged = _judged(spark, root)
    # Two one-row tables side by side.
    return verdict.batch_summary(verdict.ladder(judged, ["fetch_id"])).crossJoin(verdict.crawl_statistics(judged))


_ADVICE = " ".join(f"when '{k}' then {t.q(v)}" for k, v in verdict.ADVICE.items())


@query(
    "failure_report",
    f"""with {ATTEMPTS}, {LADDER.format(source='att')} select kind, case when kind in ('login', 'blocked') then 2 else 1 end as level,
    case kind {_ADVICE} end as advice, count(*) as fetches from best where kind <> 'ok' group by all""",
)
def failure_report(spark, root):
    return verdict.failure_report(verdict.ladder(_judged(spark, root), ["fetch_id"]))


@query(
    "politeness_audit",
    f"""with {ATTEMPTS}, g as (select host, epoch_us(ts) - lag(epoch_us(ts)) over (partition by host order by ts, attempt_id) as gap from att)
    select host, count(*) as requests, count(*) filter (gap < 60000000) as too_close, min(gap) as smallest_gap_us,
      round(avg(gap) / 1e6, 3) as mean_gap_seconds from g group by host""",
)
def politeness_audit(spark, root):
    """Spacing of requests per host against a delay of one minute."""
    a = fixtures.attempts(spark, root).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    day = F.floor(F.col("us") / (86_400 * 1_000_000))
    rows = ordered.previous(a, ["host"], ["us", "attempt_id"], day, F.col("us"), "before")
    gap = F.col("us") - F.col("before.value")
    return rows.groupBy("host").agg(
        F.count("*").alias("requests"), F.count_if(gap < 60_000_000).alias("too_close"),
        F.min(gap).alias("smallest_gap_us"), F.round(F.avg(gap) / 1e6, 3).alias("mean_gap_seconds"),
    )


@query(
    "request_rate",
    f"""with {ATTEMPTS} select host, strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M:%S') as hour, count(*) as requests from att group by all""",
)
def request_rate(spark, root):
    a = fixtures.attempts(spark, root)
    return a.groupBy("host", F.window("ts", "1 hour")).agg(F.count("*").alias("requests")).select(
        "host", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "requests"
    )


@query(
    "block_bursts",
    f"""with {ATTEMPTS},
    b as (select host, ts, case when lag(ts) over w is null or ts - lag(ts) over w > interval '2 hours' then 1 else 0 end as fresh
          from att where status = 403 window w as (partition by host order by ts)),
    i as (select *, sum(fresh) over (partition by host order by ts rows unbounded preceding) as n from b)
    select host, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as ended, count(*) as blocked
    from i group by host, n""",
)
def block_bursts(spark, root):
    """Bursts of refusals per host: no two further apart than two hours."""
    a = fixtures.attempts(spark, root).filter(F.col("status") == 403)
    out = ordered.islands(a, ["host"], "ts", 7200)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return out.select("host", stamp("start").alias("started"), stamp("end").alias("ended"), F.col("rows").alias("blocked"))


@query(
    "watch_changes",
    """select user_id, event_id, old, event_type as new from (
      select *, lag(event_type) over w as old, row_number() over w as n from events window w as (partition by user_id order by ts, event_id))
    where n = 1 or old is distinct from event_type""",
)
def watch_changes(spark, root):
    """Changes of a watched value (the last event type of a user) against the one before."""
    e = table(spark, root, "events").select("user_id", "event_id", "ts", "event_type")
    rows = ordered.previous(e, ["user_id"], ["ts", "event_id"], F.to_date("ts"), F.col("event_type"), "before")
    changed = F.col("before").isNull() | ~F.col("before.value").eqNullSafe(F.col("event_type"))
    return rows.filter(changed).select("user_id", "event_id", F.col("before.value").alias("old"), F.col("event_type").alias("new"))


_PROBLEM = f"""
variant as (
  select page_id, url as requested_url, case when page_id % 8 = 7 and page_id % 3 = 0 then 'https://example.com/authwall?next=x' else url end as url,
    case when page_id % 40 = 8 then 410 else 200 end as status,
    case page_id % 8
      when 1 then '<!doctype html><title>Attention Required! Harbour office</title><p>The tide table opens after a short test. Ticket ' || page_id || '.</p>'
      when 2 then '<body><p>The lighthouse log is behind a gate, ticket ' || page_id || '.</p>' || [{", ".join(t.q(m) for m in fixtures.GATES)}][page_id // 8 % {len(fixtures.GATES)} + 1] || '</body>'
      when 3 then '<body><section id="__next"></section><script src="/harbour/main.js"></script></body>'
      when 4 then '<body><div id="svelte"><h2>Tides</h2><p>' || repeat('high water at noon, ', 18) || page_id || '</p></div></body>'
      when 5 then replace(html, '<title>', '<title>Access Denied ')
      when 6 then '<body><h1>Ferry desk</h1><p>Unusual traffic was seen from pier ' || page_id || '.</p></body>'
      else html end as html
  from pages),
"""
_FEATS = """
feat as (
  select v.page_id, v.status, v.url, v.requested_url, lower(v.html) as head, coalesce(x.text, '') as text, length(coalesce(x.text, '')) as n, coalesce(title, '') as title
  from variant v left join titles using (page_id)
  left join (select page_id, string_agg(text, chr(10) order by pos) as text from txt where text <> '' group by page_id) x on x.page_id = v.page_id)
"""


@query(
    "diagnose_pages",
    t.page_sql(
        f"""select page_id, split_part(v, '~~', 1) as kind, split_part(v, '~~', 2) as reason from (
      select page_id, case when status = 410 then 'notfound~~HTTP 410'
        when contains(url, '/authwall') then 'login~~sent to a sign-in page'
        when n < 4000 and regexp_matches(title, {t.q(verdict.BLOCKED_TITLE)}) then 'blocked~~asks for a human: ' || left(title, 60)
        {" ".join(f"when n < 2500 and regexp_matches(head, {t.q(pattern)}) then 'blocked~~marker of {name}'" for name, pattern in verdict.VENDORS)}
        when n < 2500 and regexp_matches(text, {t.q(verdict.PHRASES)}) then 'blocked~~asks for a human: ' || regexp_extract(text, {t.q(verdict.PHRASES)})
        when n < 200 and contains(head, '<script') then 'empty~~only scripts around ' || n || ' characters'
        when n < 800 and regexp_matches(head, {t.q(verdict.JS_ROOT)}) then 'empty~~empty application root, ' || n || ' characters'
        else 'ok~~' end as v from feat)""",
        _FEATS, _PROBLEM, "variant",
    ),
)
def diagnose_pages(spark, root):
    d = verdict.diagnose(fixtures.problem_pages(spark, root), F.lit("text/html"))
    return d.select("page_id", F.coalesce("problem.kind", F.lit("ok")).alias("kind"), F.coalesce("problem.reason", F.lit("")).alias("reason"))


@query(
    "probe_pages",
    t.page_sql(
        """select page_id, case when status = 410 then 'notfound' when contains(url, '/authwall') then 'login'
        when exists (from nodes n where n.page_id = v.page_id and n.tag = 'article') then 'ok' else 'empty' end as kind from variant v""",
        "", _PROBLEM, "variant",
    ),
)
def probe_pages(spark, root):
    """The same pages when an article element is asked for: its presence settles the matter."""
    d = verdict.diagnose(
        fixtures.problem_pages(spark, root), F.lit("text/html"), probe=[(Step(tag="article"),)], probe_name="article"
    )
    return d.select("page_id", F.coalesce("problem.kind", F.lit("ok")).alias("kind"))
