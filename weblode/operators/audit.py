"""Which URLs may leave, and where they lead: host, secret and route tests."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, functions as F

from weblode.functions import urls
from weblode.functions.text import apply, let

# Name endings of internal hosts.
INTERNAL = (
    ".local", ".internal", ".lan", ".test", ".localhost", ".corp", ".home", ".intranet", ".localdomain", ".home.arpa",
    ".ts.net", ".onion",
)
# Fixed value: parameter names that usually carry credentials.
SECRET_NAME = (
    r"(?i)token|secret|passw|pwd|signature|credential|apikey|jwt|sess|auth(?!or)"
    r"|(?:^|[_\-.])(?:key|sig|code|sid)(?:$|[_\-.])"
)
# Address blocks the IANA registries do not call globally
# reachable, and the exceptions inside them.
CLOSED_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
)
OPEN_V4 = ("192.0.0.9/32", "192.0.0.10/32")
CLOSED_V6 = (
    "::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10",
)
OPEN_V6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")

_V4 = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"


def _v4_number(h: Column) -> Column:
    parts = F.transform(F.split(h, r"\."), lambda p: p.try_cast("long"))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 256 + p)


def _in_v4(n: Column, blocks) -> Column:
    test = F.lit(False)
    for b in map(ipaddress.ip_network, blocks):
        test = test | n.between(int(b[0]), int(b[-1]))
    return test


def _v6_text(h: Column) -> Column:
    """The 32 hex digits of an IPv6 address, or null; a dotted tail counts as two groups."""
    return apply(
        h,
        r"""h -> get(transform(array(
              case when h rlike r'^[0-9a-f:]*:(\d+\.){3}\d+$'
                   then concat(regexp_extract(h, r'^(.*:)[^:]*$', 1),
                        array_join(transform(array(1, 3), k -> lower(concat(
                            lpad(hex(cast(split(regexp_extract(h, r'([^:]*)$', 1), r'\.')[k - 1] as bigint)), 2, '0'),
                            lpad(hex(cast(split(regexp_extract(h, r'([^:]*)$', 1), r'\.')[k] as bigint)), 2, '0')))), ':'))
                   else h end), f ->
              get(transform(array(struct(filter(split(substring_index(f, '::', 1), ':'), g -> g <> '') as a,
                    case when instr(f, '::') > 0 then filter(split(substring_index(f, '::', -1), ':'), g -> g <> '') else cast(array() as array<string>) end as b)), x ->
                case when f rlike r'^[0-9a-f:]+$' and (size(x.a) + size(x.b) = 8 or (instr(f, '::') > 0 and size(x.a) + size(x.b) < 8))
                     then array_join(transform(concat(x.a, array_repeat('0', 8 - size(x.a) - size(x.b)), x.b), g -> lpad(g, 4, '0')), '') end), 0)), 0)""",
    )


def _in_v6(text: Column, blocks) -> Column:
    test = F.lit(False)
    for b in map(ipaddress.ip_network, blocks):
        test = test | text.between(f"{int(b[0]):032x}", f"{int(b[-1]):032x}")
    return test


def is_public_host(host: Column) -> Column:
    """A dotted name outside internal suffixes, or a globally reachable address."""

    def v4_ok(n: Column) -> Column:
        return ~_in_v4(n, CLOSED_V4) | _in_v4(n, OPEN_V4)

    def v6_ok(digits: Column) -> Column:
        mapped = F.conv(F.right(digits, F.lit(8)), 16, 10).cast("long")
        plain = ~_in_v6(digits, CLOSED_V6) | _in_v6(digits, OPEN_V6)
        return F.when(digits.startswith("0" * 20 + "ffff"), let(mapped, v4_ok)).otherwise(plain)

    def name_ok(h: Column) -> Column:
        return h.contains(".") & ~F.rlike(h, F.lit("(" + "|".join(s.replace(".", r"\.") for s in INTERNAL) + ")$"))

    def test(h: Column) -> Column:
        return (
            F.when(h == "", F.lit(False)).when(h.rlike(_V4), let(_v4_number(h), v4_ok))
            .when(h.contains(":"), F.coalesce(let(_v6_text(h), v6_ok), F.lit(False))).otherwise(name_ok(h))
        )

    return let(F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), r"\.+$", ""), test)


def has_secret_params(url: Column) -> Column:
    """Any query or fragment name that looks like a credential."""
    names = F.transform(F.concat(urls.pairs(urls.query(url)), urls.pairs(urls.fragment(url))), lambda p: p["name"])
    return F.exists(names, lambda n: n.rlike(SECRET_NAME))


def sharing_problems(url: Column, credentials: Column | None = None) -> Column:
    """Reasons not to hand a URL to a third party; empty when it may go."""
    return let(url, lambda u: _sharing_problems(u, credentials))


def _sharing_problems(url: Column, credentials: Column | None) -> Column:
    reasons = [
        F.when(urls.userinfo(url) != "", F.lit("carries a user name")),
        F.when(~is_public_host(urls.host(url)), F.lit("host is not public")),
        F.when(has_secret_params(url), F.lit("parameter looks like a credential")),
    ]
    if credentials is not None:
        reasons.append(F.when(credentials, F.lit("credentials are in play")))
    return F.array_compact(F.array(*reasons))


def may_receive_credentials(url: Column, site: Column) -> Column:
    """Credentials given for a site go to it and what is below it, nowhere else."""
    return F.coalesce(site != "", F.lit(False)) & urls.host_is(urls.host(url), site)


# Fixed value: first path parts that are no repository owners.
NOT_OWNERS = ("orgs", "topics", "search", "settings", "marketplace", "sponsors")


def route(url: Column) -> Column:
    """Which platform reader a URL belongs to: video, tweet, reddit, github, or null."""
    h, p = urls.host(url), urls.path(url)
    on = urls.host_is
    return (
        F.when(on(h, "youtu.be") | (on(h, "youtube.com") & p.rlike(r"^/(watch|shorts/|live/|embed/|playlist)")), F.lit("video"))
        .when(on(h, "x.com", "twitter.com") & p.rlike(r"/status(es)?/\d+"), F.lit("tweet"))
        .when(on(h, "reddit.com") & ~p.contains("/comments/") & ~p.rlike(r"/s/\w+"), F.lit("reddit"))
        .when(on(h, "github.com") & p.rlike(r"^/[^/]+/[^/]+/?$") & ~F.get(F.split(p, "/"), F.lit(1)).isin(*NOT_OWNERS), F.lit("github"))
    )


def routed(url: Column, needs_dom: Column, wants_browser: Column, mode: Column) -> Column:
    """The route, where no option asks for the page itself."""
    return F.when(~needs_dom & ~wants_browser & (mode == "auto"), route(url))
