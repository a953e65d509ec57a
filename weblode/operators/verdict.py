"""Is a stored answer usable?  Verdicts, the tier ladder, and reports on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


from weblode.functions.urls import path
from weblode.operators import dom
from weblode.operators.rows import settle
from weblode.operators.select import Step, select_any

# The statuses, words and markers verdicts rest on.
GONE = (404, 410)
BLOCKED = (401, 403, 407, 429, 444, 503, 520, 521, 522, 523, 525, 526)
BLOCKED_TITLE = (
    r"(?i)^just a moment|^un momento|attention required|^access denied|robot check|^security check"
    r"|are you (a )?human|pardon our interruption|^captcha$"
)
VENDORS = (
    ("cloudflare", r'cf_chl_opt|cf-chl-|challenge-error-text|cf-browser-verification|id="challenge-form"'),
    ("datadome", r"captcha-delivery\.com"),
    ("perimeterx", r'id="px-captcha"|px-captcha-wrapper'),
    ("imperva", r"_incapsula_resource|incapsula incident id"),
    ("akamai", r"errors\.edgesuite\.net"),
)
PHRASES = (
    r"(?i)verif(?:y|ying) (?:that )?you are (?:a )?human|are you a robot|unusual traffic|blocked by network security"
    r"|enable javascript and cookies to continue|complete the security check|checking your browser"
    r"|access to this page has been denied|press & hold|enter the characters you see below"
    r"|automated access to amazon|request unsuccessful\. incapsula"
)
JS_ROOT = r"""(?i)id=["'](root|app|__next|__nuxt|svelte|app-root)["']|ng-version=|data-reactroot|<noscript>[^<]{0,300}javascript"""
LOGIN_PATH = r"(?i)/(login|log-in|signin|sign-in|authwall|checkpoint|accounts/login|i/flow/login|uas/login)(/|$)"
TITLE_BELOW, MARKERS_BELOW, SCRIPT_SHELL_BELOW, ROOT_SHELL_BELOW = 4000, 2500, 200, 800
MARKER_HEAD = 300_000


def _verdict(kind: str, reason) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.lit(kind).alias("kind"), reason.alias("reason"))


def status_rule(status: Column) -> Column:
    code = F.coalesce(status, F.lit(0))
    text = F.concat(F.lit("HTTP "), code.cast("string"))
    return F.when(code.isin(*GONE), _verdict("notfound", text)).when(
        code.isin(*BLOCKED) | (code >= 400), _verdict("blocked", text)
    )


def is_html(media: Column) -> Column:
    return (media == "") | media.contains("html")


def login_redirect(final_path: Column, requested_path: Column) -> Column:
    return final_path.rlike(LOGIN_PATH) & ~requested_path.rlike(LOGIN_PATH)


def by_headers(status: Column, media: Column, final_path: Column, requested_path: Column) -> Column:
    """The part of the verdict that needs no page content: null when nothing is wrong so far."""
    return F.coalesce(
        status_rule(status),
        F.when(is_html(media) & login_redirect(final_path, requested_path), _verdict("login", "sent to a sign-in page")),
    )


def features(doms: DataFrame, html: str = "html") -> DataFrame:
    """Adds what the content rules look at: text, its length, title, lower-cased head."""
    text = settle(doms, ["*"], _text=dom.page_text(), _title=dom.page_title(), _head=F.lower(F.left(F.col(html), F.lit(MARKER_HEAD))))
    return text.withColumn("_len", F.length("_text"))


def diagnose(
    pages: DataFrame, media: Column, probe: Sequence[Sequence[Step]] | None = None, probe_name: str = "",
    detect: bool = True, rendered: Column | None = None,
) -> DataFrame:
    """Adds ``problem`` (kind, reason), null where the page is usable.

    Rules apply in order: status, non-HTML accepted, login redirect, asked-for
    element, then (unless switched off) title, vendor markers, phrases and
    un-rendered shells on short pages.
    """
    rendered = F.lit(False) if rendered is None else rendered
    # Header rules come first: what they settle, and what is no HTML, is not lexed.
    headers = by_headers(F.col("status"), media, path("url"), path("requested_url"))
    d = settle(pages, ["*"], _headers=headers)
    d = dom.with_nodes(d.withColumn("_lex", F.when(F.col("_headers").isNull() & is_html(media), F.col("html")).otherwise("")), "_lex")
    if probe is not None:
        found = F.size(select_any("nodes", probe)) > 0
        content = F.when(~found, _verdict("empty", f"no element meets {probe_name}"))
    elif not detect:
        content = F.lit(None).cast("struct<kind:string,reason:string>")
    else:
        d = features(d)
        text, n, title, head = F.col("_text"), F.col("_len"), F.col("_title"), F.col("_head")
        quoted = lambda x: F.concat(F.lit("asks for a human: "), x)
        short = n < MARKERS_BELOW
        content = F.when(
            (n < TITLE_BELOW) & title.rlike(BLOCKED_TITLE), _verdict("blocked", quoted(F.left(title, F.lit(60))))
        )
        for name, pattern in VENDORS:
            content = content.when(short & head.rlike(pattern), _verdict("blocked", f"marker of {name}"))
        content = (
            content.when(short & text.rlike(PHRASES), _verdict("blocked", quoted(F.regexp_extract(text, PHRASES, 0))))
            .when(
                ~rendered & (n < SCRIPT_SHELL_BELOW) & head.contains("<script"),
                _verdict("empty", F.concat(F.lit("only scripts around "), n.cast("string"), F.lit(" characters"))),
            )
            .when(
                ~rendered & (n < ROOT_SHELL_BELOW) & head.rlike(JS_ROOT),
                _verdict("empty", F.concat(F.lit("empty application root, "), n.cast("string"), F.lit(" characters"))),
            )
        )
    problem = F.coalesce("_headers", F.when(is_html(media), content))
    return settle(d, [c for c in d.columns if c not in ("_text", "_len", "_title", "_head", "_headers")], problem=problem)


# Tiers in the order they are tried, and which stay on this machine.
TIERS = ("http", "stealth", "exa", "jina")
LOCAL = ("http", "stealth", "dynamic")
REMOTE_MIN_TEXT = 200
REMOTE_BLOCK_NOTES = ("target url returned error", "requiring captcha", "title: just a moment")


def remote_problem(text: Column) -> Column:
    """Why the stored Markdown of a remote reader is not accepted, or null."""
    head = F.lower(F.left(text, F.lit(4096)))
    noted = F.lit(False)
    for note in REMOTE_BLOCK_NOTES:
        noted = noted | head.contains(note)
    return F.when(noted, F.lit("a refusal, not the page")).when(F.length(F.trim(text)) < REMOTE_MIN_TEXT, F.lit("too little text"))


def judged(attempts: DataFrame) -> DataFrame:
    """Adds ``local`` and ``problem`` to attempts that carry status, media type and paths.

    Remote attempts are judged by the length of their text alone.
    """
    local = F.col("tier").isin(*LOCAL)
    here = by_headers(F.col("status"), F.col("media"), F.col("final_path"), F.col("requested_path"))
    there = F.when(F.col("n_chars") < REMOTE_MIN_TEXT, _verdict("error", "too little text"))
    return settle(attempts.withColumn("local", local), ["*"], problem=F.when(F.col("local"), here).otherwise(there))


def ladder(judged_attempts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The outcome of each fetch: winner, problem, and the trail of rejections.

    One aggregate per fetch, so attempts are combined before they are
    shuffled.  A usable local attempt wins by rank unless a missing page or a
    login wall came before it; remote ones count only after a local answer
    that did not ask for authentication.
    """
    one = F.struct(
        F.col("tier_rank").alias("rank"), F.col("tier"), F.col("problem.kind").alias("kind"), F.col("problem.reason").alias("reason")
    )
    local, usable = F.col("local"), F.col("problem").isNull()
    stops = F.col("problem.kind").isin("notfound", "login")
    got = judged_attempts.groupBy(*keys).agg(
        F.min(F.when(local & usable, one)).alias("ok"),
        F.min(F.when(local & stops, one)).alias("stop"),
        F.min(F.when(~local & usable, one)).alias("remote"),
        F.max(F.when(local, one)).alias("last"),
        F.coalesce(F.bool_or(local & F.col("status").isin(401, 407)), F.lit(False)).alias("asks_auth"),
        # One struct per tier, the last rejection of a repeated one: the list has as many entries as there are tiers.
        F.array_sort(F.array_compact(F.array(*[F.max(F.when(~usable & (F.col("tier") == t), one)) for t in dict.fromkeys(TIERS + LOCAL)]))).alias("rejected"),
    )
    none = F.struct(F.lit(99).alias("rank"), F.lit(None).cast("string").alias("tier"), F.lit("error").alias("kind"), F.lit("nothing came back").alias("reason"))
    may_ask = F.col("last").isNotNull() & ~F.col("asks_auth")
    winner = (
        F.when(F.col("ok").isNotNull() & (F.col("stop").isNull() | (F.col("ok.rank") < F.col("stop.rank"))), F.col("ok"))
        .when(F.col("stop").isNotNull(), F.col("stop"))
        .when(may_ask & F.col("remote").isNotNull(), F.col("remote"))
        .otherwise(F.coalesce(F.col("last"), none))
    )
    w = got.withColumn("win", winner).withColumn("may_ask", may_ask)
    solved = F.col("win.kind").isNull()
    considered = F.filter(
        "rejected",
        lambda r: F.when(solved, r["rank"] < F.col("win.rank"))
        .when(F.col("stop").isNotNull(), r["rank"] <= F.col("stop.rank"))
        .otherwise(r["tier"].isin(*LOCAL) | F.col("may_ask")),
    )
    return w.select(
        *keys, F.col("win.tier").alias("tier"), F.coalesce("win.kind", F.lit("ok")).alias("kind"), F.col("win.reason").alias("reason"),
        F.transform(considered, lambda r: F.struct(r["tier"].alias("tier"), r["reason"].alias("reason"))).alias("trail"),
        "may_ask", "asks_auth", F.col("last").isNotNull().alias("answered"),
    )


def next_tier(judged_attempts: DataFrame, keys: Sequence[str], retry: Column | None = None) -> DataFrame:
    """What to try next for each fetch, or why to stop.

    ``retry`` is a condition over attempt columns; where the last local
    attempt meets it, that tier is tried again.
    """
    out = ladder(judged_attempts, keys)
    again = F.lit(False) if retry is None else retry
    tried = judged_attempts.groupBy(*keys).agg(
        F.max("tier_rank").alias("reached"),
        F.max_by(F.when(again & F.col("local"), F.col("tier")), "tier_rank").alias("retry"),
    )
    following = F.get(F.array(*[F.lit(t) for t in TIERS]), F.col("reached") + 1)
    plan = (
        F.when(F.col("kind") == "ok", F.lit("done"))
        .when(F.col("kind").isin("notfound", "login"), F.concat(F.lit("stop: "), "kind"))
        .when(F.col("retry").isNotNull(), F.concat(F.lit("retry: "), "retry"))
        .when(following.isNull(), F.lit("stop: every tier was tried"))
        .when(following.isin(*LOCAL), following)
        .when(~F.col("answered"), F.lit("stop: no local tier got a response"))
        .when(F.col("asks_auth"), F.lit("stop: the site asks for authentication"))
        .otherwise(following)
    )
    return out.join(tried, list(keys)).select(*keys, "kind", "reached", plan.alias("plan"))


# Exit level by kind, and what to advise (our own words).
LEVEL = {"ok": 0, "notfound": 1, "empty": 1, "error": 1, "login": 2, "blocked": 2}
ADVICE = {
    "ok": "",
    "error": "no answer: check address and connection, or use a stored remote copy",
    "notfound": "the page does not exist: check the URL",
    "login": "needs a signed-in session: leave it out or ask its owner for access",
    "empty": "nothing matched: look at the outline and choose another selector",
    "blocked": "the site refused: slow down, ask for access, or accept the gap",
}


def of_kind(kind: Column, table: dict) -> Column:
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


def batch_summary(outcomes: DataFrame) -> DataFrame:
    """ok of total, and the exit level: 0 if any is ok, else 2 if any is blocked or behind a login, else 1."""
    level = of_kind(F.col("kind"), LEVEL)
    return outcomes.agg(
        F.count_if(F.col("kind") == "ok").alias("ok"), F.count("*").alias("total"),
        F.when(F.count_if(F.col("kind") == "ok") > 0, 0).when(F.max(level) == 2, 2).otherwise(1).alias("level"),
    )


def crawl_statistics(judged_attempts: DataFrame) -> DataFrame:
    kind = F.col("problem.kind")
    return judged_attempts.agg(
        F.count("*").alias("requests"),
        F.count_if(kind.isin("notfound", "error")).alias("failed"),
        F.count_if(kind == "blocked").alias("blocked"),
        F.count_if(kind == "login").alias("behind_login"),
        F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")).alias("elapsed_seconds"),
    )


def failure_report(outcomes: DataFrame) -> DataFrame:
    """Failed fetches counted by kind, with level and advice."""
    kind = F.col("kind")
    return outcomes.filter(kind != "ok").groupBy("kind").agg(F.count("*").alias("fetches")).select(
        "kind", of_kind(kind, LEVEL).alias("level"), of_kind(kind, ADVICE).alias("advice"), "fetches"
    )


def host_health(judged_attempts: DataFrame) -> DataFrame:
    """Attempts per host and kind, with their share of the host's attempts."""
    from pyspark.sql import Window

    kind = F.coalesce(F.col("problem.kind"), F.lit("ok"))
    counts = judged_attempts.groupBy("host", kind.alias("kind"), (F.floor(F.col("status") / 100)).cast("int").alias("status_class")).agg(
        F.count("*").alias("attempts")
    )
    return counts.withColumn("share", F.round(F.col("attempts") / F.sum("attempts").over(Window.partitionBy("host")), 6))
