"""Sitemaps, pagination, crawl reach, robots rules, resuming."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window, functions as F

from weblode.functions import urls
from weblode.functions.text import strip, unescape
from weblode.operators.select import Pick, values
from weblode.operators.waves import Growing, counted, durable

# Fixed value: where sitemaps are looked for when robots.txt names none.
DEFAULT_SITEMAPS = ("/sitemap.xml", "/sitemap_index.xml", "/wp-sitemap.xml")


def locations(body: Column) -> Column:
    """``<loc>`` values of a sitemap body, CDATA or not, decoded and trimmed."""
    found = F.regexp_extract_all(body, F.lit(r"<loc>\s*(?:<!\[CDATA\[)?([^<\]]+)"), F.lit(1))
    return F.transform(found, lambda x: unescape(strip(x)))


def is_index(body: Column) -> Column:
    return F.left(body, F.lit(2000)).contains("<sitemapindex")


def sitemap_roots(robots: DataFrame) -> DataFrame:
    """(site, url, pos): sitemaps named in (site, body) robots rows, else the default places."""
    named = F.regexp_extract_all("body", F.lit(r"(?im)^sitemap:[ \t]*(\S+)"), F.lit(1))
    default = F.array(*[F.concat("site", F.lit(p)) for p in DEFAULT_SITEMAPS])
    found = F.when(F.size(F.coalesce(named, F.array().cast("array<string>"))) > 0, named).otherwise(default)
    return robots.select("site", F.posexplode(found).alias("pos", "url"))


def expand_sitemaps(
    roots: DataFrame, docs: DataFrame, match: str | None = None, limit: int | None = None, max_docs: int | None = None
) -> DataFrame:
    """(site, url, path): page URLs below the roots, each once, in discovery order.

    ``docs`` is (doc_url, body).  Documents are read level by level, so nested
    indexes come first-in first-out; ``path`` sorts URLs as they were found.
    ``max_docs`` and ``limit`` cut per site along that order.
    """
    place = lambda p: F.lpad(p.cast("string"), 8, "0")
    front = roots.groupBy("site", "url").agg(F.min(F.concat(place(F.col("pos")), F.lit("~"), "url")).alias("path"))
    seen = None
    found = []
    used = None
    for depth in count():
        hits = front.join(docs, front["url"] == docs["doc_url"]).select("site", "url", "path", "body")
        if max_docs is not None:
            order = Window.partitionBy("site").orderBy("path")
            spent = 0 if used is None else F.coalesce(F.col("_used"), F.lit(0))
            hits = hits.withColumn("_n", F.row_number().over(order))
            hits = hits if used is None else hits.join(used, "site", "left")
            hits = hits.filter(F.col("_n") + spent <= max_docs).select("site", "url", "path", "body")
        level = durable(hits.select("site", "url", "path", is_index(F.col("body")).alias("index"), locations(F.col("body")).alias("locs")))
        if max_docs is not None:
            here = level.groupBy("site").agg(F.count("*").alias("_here"))
            used = here.withColumnRenamed("_here", "_used") if used is None else (
                used.join(here, "site", "full").select("site", (F.coalesce("_used", F.lit(0)) + F.coalesce("_here", F.lit(0))).alias("_used")))
        seen = level.select("site", "url") if seen is None else seen.unionByName(level.select("site", "url"))
        kids = level.select("site", "index", F.col("path").alias("_up"), F.posexplode("locs").alias("pos", "url"))
        kids = kids.withColumn("path", F.concat(F.lit(f"{depth:08d}/"), F.regexp_replace("_up", r"^\d{8}/", ""), F.lit("/"), place(F.col("pos"))))
        found.append(kids.filter(~F.col("index")).select("site", "url", "path"))
        nested = kids.filter("index").groupBy("site", "url").agg(F.min("path").alias("path"))
        front = durable(nested.join(seen, ["site", "url"], "left_anti"))
        if front.isEmpty():
            break
    pages = found[0]
    for more in found[1:]:
        pages = pages.unionByName(more)
    if match:
        pages = pages.filter(F.col("url").rlike(urls.check_pattern(match, "match")))
    # A sitemap listed as a page is no page.
    first = pages.groupBy("site", "url").agg(F.min("path").alias("path")).join(seen, ["site", "url"], "left_anti")
    if limit is not None:
        first = first.withColumn("_n", F.row_number().over(Window.partitionBy("site").orderBy("path"))).filter(F.col("_n") <= limit).drop("_n")
    return first


def one_per_url(pages: DataFrame, order: Sequence[str] = ("page_id",)) -> DataFrame:
    """One row a URL: the first by ``order`` (of the columns there are); what is left equal is settled by the other columns."""
    rest = [c for c in pages.columns if c != "url"]
    first = [c for c in order if c in rest]
    by = F.struct(*first, *[c for c in rest if c not in first])
    return pages.groupBy("url").agg(F.min_by(F.struct(*rest), by).alias("_p")).select("url", "_p.*")


def next_links(doms: DataFrame, link: Pick, keep: Sequence[str] = ("page_id",), base: str = "url") -> DataFrame:
    """(keep..., url, next_url): the first link a selector finds in each page, absolute and without its fragment."""
    found = F.get(values("nodes", link, base), F.lit(0))
    return doms.select(*keep, urls.drop_fragment(F.col(base)).alias("url"), urls.drop_fragment(found).alias("next_url"))


def paginate(starts: DataFrame, pages: DataFrame, max_pages: int = 5, order: Sequence[str] = ("page_id",)) -> DataFrame:
    """(start, page_no, url): pages reached by following ``next_url`` from each start.

    ``pages`` is (url, next_url, usable, ...); of a URL stored several times the
    first row by ``order`` counts, for the page and for its link.  A chain ends
    at the cap, at a repeat, without a next link, or before a page that is
    missing or unusable.

    Pointers double: after k rounds every page knows the one 2**k links ahead,
    and a chain has 2**k pages, so 1,500 pages take 11 rounds.  A page met again keeps its first
    number, and once no chain grows the rounds end.
    """
    one = one_per_url(pages.select("url", "next_url", "usable", *[c for c in order if c in pages.columns]), order)
    good = durable(one.filter("usable").select("url", "next_url"), "pages")
    jump = good.select("url", F.col("next_url").alias("to")).filter("to <> url").join(good.select(F.col("url").alias("to")), "to", "left_semi")
    begin = starts.select("url").distinct().join(good.select("url"), "url", "left_semi")
    chain, size = counted(begin.select(F.col("url").alias("start"), F.lit(1).alias("page_no"), "url"), "chains")
    ahead = 1
    while ahead < max_pages:
        jump, more = counted(jump.select("url", "to"), "jumps")
        if not more:
            break
        far = chain.join(jump, "url").select("start", (F.col("page_no") + ahead).alias("page_no"), F.col("to").alias("url"))
        both = chain.unionByName(far.filter(F.col("page_no") <= max_pages))
        chain, now = counted(both.groupBy("start", "url").agg(F.min("page_no").alias("page_no")), "chains")
        if now == size:
            break
        size, ahead = now, ahead * 2
        jump = jump.join(jump.select(F.col("url").alias("to"), F.col("to").alias("_far")), "to").select("url", F.col("_far").alias("to"))
    return chain.select("start", "page_no", "url")


def accumulated(chain: DataFrame, rows: DataFrame, limit: int = 0, key: str = "url") -> DataFrame:
    """Rows of the pages of a chain, in page order, cut at ``limit`` per chain.

    ``_row`` numbers the rows of a page; rows of one number follow each other by
    their other columns.  Rows are ranked inside their page, and the pages of a
    chain add up their counts, so no chain is sorted as a whole.
    """
    if not limit:
        return chain.join(rows, key)
    rest = sorted(c for c in rows.columns if c not in (key, "_row"))
    placed = rows.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy("_row", *rest)))
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy("start").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1))
    kept = chain.join(sizes, key).withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < limit).drop("_size")
    return kept.join(placed.filter(F.col("_at") <= limit), key).filter(F.col("_before") + F.col("_at") <= limit).drop("_before", "_at")


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(host, rule, allow) for one agent out of (host, body) robots.txt rows.

    Lines are folded in order.  Agent lines that follow each other share the
    rules below them; all groups of an agent count; an agent without a group
    falls back to ``*``.  Comments go, names and keys know no case, a rule
    without a path says nothing.
    """
    lines = F.transform(F.split("body", r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"(?s)#.*", ""))
    fields = F.transform(
        lines, lambda x: F.struct(F.lower(strip(F.split_part(x, F.lit(":"), F.lit(1)))).alias("key"), strip(F.regexp_extract(x, r"(?s)^[^:]*:(.*)", 1)).alias("value")))
    rule_list = "array<struct<rule:string,allow:boolean>>"
    start = F.struct(
        F.lit(False).alias("mine"), F.lit(False).alias("all"), F.lit(False).alias("ruled"), F.lit(False).alias("known"),
        F.array().cast(rule_list).alias("own"), F.array().cast(rule_list).alias("common"))

    def step(a: Column, line: Column) -> Column:
        named, value = line["key"] == "user-agent", line["value"]
        rule = line["key"].isin("allow", "disallow")
        mine = F.lower(value) == agent.lower()
        # An agent line after rules begins a new group.
        on = lambda flag, hit: F.when(named, (~a["ruled"] & a[flag]) | hit).otherwise(a[flag])
        entry = F.struct(value.alias("rule"), (line["key"] == "allow").alias("allow"))
        grown = lambda of, flag: F.when(rule & (value != "") & a[flag], F.array_append(a[of], entry)).otherwise(a[of])
        return F.struct(
            on("mine", mine).alias("mine"), on("all", value == "*").alias("all"), F.when(named, False).otherwise(a["ruled"] | rule).alias("ruled"),
            (a["known"] | (named & mine)).alias("known"), grown("own", "mine").alias("own"), grown("common", "all").alias("common"))

    rules = F.aggregate(fields, start, step, lambda a: F.when(a["known"], a["own"]).otherwise(a["common"]))
    return robots.select("host", F.inline(rules)).distinct()


def allowed_by_robots(candidates: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Candidates their host's rules permit: the longest matching rule wins, allow wins ties.

    The rules of a host, those of its one robots file, become one array, so a
    hot host costs its rows one look-up each and no row is multiplied.  Rules
    are prefixes; only those with ``*`` or a closing ``$`` need a pattern.
    """
    per_host = rules.groupBy("host").agg(F.collect_list(F.struct("rule", "allow")).alias("_rules"))
    target = F.concat(urls.path(url), F.when(urls.query(url) != "", F.concat(F.lit("?"), urls.query(url))).otherwise(F.lit("")))
    quoted = lambda rule: F.regexp_replace(rule, r"([.+?^(){}\[\]|\\]|\$(?!$))", r"\\$1")
    pattern = lambda rule: F.concat(F.lit("^"), F.regexp_replace(quoted(rule), r"\*+", ".*"))
    meets = lambda r: F.when(r["rule"].rlike(r"\*|\$$"), F.rlike(F.col("_target"), pattern(r["rule"]))).otherwise(F.startswith(F.col("_target"), r["rule"]))
    d = candidates.withColumn("host", urls.host(url)).withColumn("_target", target).join(per_host, "host", "left")
    hit = F.aggregate(
        F.filter("_rules", meets),
        F.struct(F.lit(-1).alias("len"), F.lit(True).alias("allow")),
        lambda a, r: F.when(
            (F.length(r["rule"]) > a["len"]) | ((F.length(r["rule"]) == a["len"]) & r["allow"]),
            F.struct(F.length(r["rule"]).alias("len"), r["allow"].alias("allow")),
        ).otherwise(a),
        lambda a: a["allow"],
    )
    return d.filter(F.coalesce(hit, F.lit(True))).drop("_rules", "_target", "host")


def allow_deny(url: Column, allow: Sequence[str] = (), deny: Sequence[str] = ()) -> Column:
    """A deny pattern wins; without allow patterns everything else passes."""
    ok = F.lit(not allow)
    for pattern in allow:
        ok = ok | url.rlike(urls.check_pattern(pattern, "allow"))
    for pattern in deny:
        ok = ok & ~url.rlike(urls.check_pattern(pattern, "deny"))
    return ok


#: Written tables of so many rows at most (some 10 MB of URLs) are sent to the tasks; larger ones meet the rows in a shuffle.
SMALL = 50_000


def sent(df: DataFrame, rows: int) -> DataFrame:
    """The table, marked for sending where its counted rows are few."""
    return F.broadcast(df) if rows <= SMALL else df


def reach(
    starts: DataFrame, links: DataFrame, max_pages: int | None = None, allow: Sequence[str] = (), deny: Sequence[str] = (),
    rules: DataFrame | None = None, visited: DataFrame | None = None,
) -> DataFrame:
    """(domain, url, depth): pages reached inside the domain of each start.

    ``starts`` is (domain, url), ``links`` (source, pos, url) of stored pages;
    only stored pages (sources) are reached.  Waves join the frontier with the
    links and drop what was seen; each is written to the shared folder and counted there.  ``max_pages`` cuts per domain in discovery order (wave, then
    URL).  ``visited`` holds (domain, url) of an earlier run to continue from.
    """
    spark = links.sparkSession
    # Which stored pages may be read is settled once, not in every wave.
    stored = links.select(F.col("source").alias("url")).distinct()
    pages = durable(stored if rules is None else allowed_by_robots(stored, rules), "pages")
    wanted = F.col("url").rlike("^https?://") & allow_deny(F.col("url"), allow, deny)
    edges = links.select("source", "url").filter(wanted).distinct().join(pages, "url", "left_semi")
    edges = durable(edges.withColumn("host", urls.host("url")), "edges")
    start = starts.select("domain", "url").distinct().join(pages, "url", "left_semi")
    key = ["domain", "url"]
    if visited is not None:
        visited, before = counted(visited.select(*key).distinct(), "visited")
        start = start.join(sent(visited, before), key, "left_anti")
    reached = Growing(spark, "reached")
    wave, new = reached.add(start.select(*key, F.lit(0).alias("depth")))
    total = new
    for depth in count(1):
        if not new:
            break
        step = edges.join(sent(wave.select("domain", F.col("url").alias("source")), new), "source")
        fresh = step.filter(urls.host_is("host", F.col("domain"))).select(*key).distinct()
        fresh = fresh.join(sent(reached.all().select(*key), total), key, "left_anti")
        if visited is not None:
            fresh = fresh.join(sent(visited, before), key, "left_anti")
        if max_pages is not None:
            # A domain that is full does not go on.
            full = reached.all().groupBy("domain").agg(F.count("*").alias("_n")).filter(F.col("_n") >= max_pages)
            fresh = fresh.join(full, "domain", "left_anti")
        wave, new = reached.add(fresh.select(*key, F.lit(depth).alias("depth")))
        total += new
    out = reached.all()
    if max_pages is not None:
        order = Window.partitionBy("domain").orderBy("depth", "url")
        out = out.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max_pages).drop("_n")
    return out


def frontier(reached: DataFrame, links: DataFrame, allow: Sequence[str] = (), deny: Sequence[str] = ()) -> DataFrame:
    """(domain, url) linked from reached pages, wanted and not reached themselves: where a later run continues."""
    step = reached.select("domain", F.col("url").alias("source")).join(links.select("source", "url").filter(allow_deny(F.col("url"), allow, deny)), "source")
    inside = step.filter(urls.host_is(urls.host("url"), F.col("domain"))).select("domain", "url").distinct()
    return inside.join(reached.select("domain", "url"), ["domain", "url"], "left_anti")


def check_manifest(manifest: DataFrame, domain: str) -> None:
    """A crawl folder belongs to one domain; refuse another."""
    other = manifest.filter(F.col("domain") != domain).select("domain").limit(1).collect()
    if other:
        raise ValueError(f"the folder holds a crawl of {other[0][0]}; use another one")


def follow_rules(reached: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Record kind of each reached page: the first (pattern, kind) rule its URL meets."""
    kind = F.lit(None).cast("string")
    for pattern, name in reversed(list(rules)):
        kind = F.when(F.col("url").rlike(urls.check_pattern(pattern, "follow rule")), F.lit(name)).otherwise(kind)
    return reached.withColumn("kind", kind).filter(F.col("kind").isNotNull())
