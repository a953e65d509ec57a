"""URL columns after RFC 3986, on built-in string functions only.

``try_parse_url`` gives null for URLs with blanks, braces or underscores in
the host, which web pages are full of; the regular expression of RFC 3986
appendix B splits every string.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from weblode.functions.text import apply, let, strip

_SCHEME = r"[a-zA-Z][a-zA-Z0-9+.-]*"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def check_pattern(pattern: str, what: str) -> str:
    """Reject a bad regular expression before the job starts."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"invalid regular expression in {what} {pattern!r}: {e}") from e
    return pattern


def scheme(u) -> Column:
    return F.lower(F.regexp_extract(_col(u), rf"^({_SCHEME}):", 1))


def netloc(u) -> Column:
    return F.regexp_extract(_col(u), rf"^(?:{_SCHEME}:)?//([^/?#]*)", 1)


def path(u) -> Column:
    return F.regexp_extract(_col(u), rf"^(?:{_SCHEME}:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(u) -> Column:
    return F.regexp_extract(_col(u), r"^[^?#]*\?([^#]*)", 1)


def fragment(u) -> Column:
    return F.regexp_extract(_col(u), r"(?s)^[^#]*#(.*)$", 1)


def userinfo(u) -> Column:
    return F.regexp_extract(netloc(u), r"^(.*)@", 1)


def host(u) -> Column:
    """Lower-case host, without user, port or the brackets of an IPv6 address."""
    place = F.regexp_extract(netloc(u), r"([^@]*)$", 1)
    return F.lower(
        F.when(place.startswith("["), F.regexp_extract(place, r"^\[([^\]]*)\]", 1)).otherwise(
            F.substring_index(place, ":", 1)
        )
    )


def site(u) -> Column:
    """Host without one leading ``www.``."""
    return F.regexp_replace(host(u), r"^www\.", "")


def origin(u) -> Column:
    return F.concat(scheme(u), F.lit("://"), netloc(u))


def normalize(u) -> Column:
    """Trimmed http(s) URL with a scheme, or null when it is none."""

    def judge(full: Column) -> Column:
        brackets = netloc(full).contains("[") == netloc(full).contains("]")
        return F.when(scheme(full).isin("http", "https") & (host(full) != "") & brackets, full)

    def complete(text: Column) -> Column:
        return F.when(text.rlike(rf"^{_SCHEME}://"), text).otherwise(F.concat(F.lit("https://"), text))

    return let(let(strip(u), complete), judge)


def host_is(h, *domains) -> Column:
    """Host equal to, or below, one of the domains (columns or text)."""
    name = _col(h)
    test = F.lit(False)
    for d in domains:
        d = F.lit(d) if isinstance(d, str) else d
        test = test | (name == d) | name.endswith(F.concat(F.lit("."), d))
    return test


def same_site(u, site_col) -> Column:
    return host_is(host(u), _col(site_col))


def drop_fragment(u) -> Column:
    return F.substring_index(_col(u), "#", 1)


def slug(u, n: int = 80) -> Column:
    """File-name text from host and path; ``index`` when nothing is left."""
    text = F.regexp_replace(F.concat(netloc(u), path(u)), r"^/+|/+$", "")
    text = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "")
    return F.left(F.coalesce(F.nullif(text, F.lit("")), F.lit("index")), F.lit(n))


def pairs(part) -> Column:
    """``a=1&b`` -> array of (name, value), blanks kept, both decoded."""
    text = _col(part)
    pieces = F.filter(F.split(text, "&"), lambda p: p != "")

    def decode(x: Column) -> Column:
        return F.coalesce(F.try_url_decode(x), x)

    return F.transform(
        pieces,
        lambda p: F.struct(
            decode(F.substring_index(p, "=", 1)).alias("name"),
            F.when(F.instr(p, "=") > 0, decode(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)))
            .otherwise(F.lit(""))
            .alias("value"),
        ),
    )


def page_template(u, slot: str = "page") -> Column:
    """The URL with the page number replaced by ``{}``."""
    return F.regexp_replace(_col(u), rf"({slot}=)\d+", "$1{}")


def _resolve_sql() -> str:
    """RFC 3986, 5.2 over ``x.base`` and ``x.ref``, as one SQL lambda."""
    part = {
        "scheme": lambda u: f"lower(regexp_extract({u}, r'^({_SCHEME}):', 1))",
        "netloc": lambda u: f"regexp_extract({u}, r'^(?:{_SCHEME}:)?//([^/?#]*)', 1)",
        "path": lambda u: f"regexp_extract({u}, r'^(?:{_SCHEME}:)?(?://[^/?#]*)?([^?#]*)', 1)",
        "query": lambda u: f"regexp_extract({u}, r'^[^?#]*\\?([^#]*)', 1)",
        "fragment": lambda u: f"regexp_extract({u}, r'(?s)^[^#]*#(.*)$', 1)",
    }
    split = lambda u: ", ".join(f"{cut(u)} as {name}" for name, cut in part.items())
    # Dot segments fall away; in a path joined to a folder, empty middle segments too.
    walk = """aggregate(
        case when startswith(r.path, '/') or size(p) < 2 then p
             else concat(slice(p, 1, 1), filter(slice(p, 2, size(p) - 2), s -> s <> ''), array(element_at(p, -1))) end,
        cast(array() as array<string>),
        (acc, s) -> case when s = '..' then slice(acc, 1, greatest(size(acc) - 1, 0)) when s = '.' then acc
                         else array_append(acc, s) end,
        acc -> array_join(case when element_at(p, -1) in ('.', '..') then array_append(acc, '') else acc end, '/'))"""
    joined = f"""get(transform(array(
        case when startswith(r.path, '/') then r.path
             else concat(coalesce(nullif(regexp_extract(b.path, r'^(.*/)[^/]*$', 1), ''), '/'), r.path) end), j ->
        case when j rlike r'(^|/)\\.{{1,2}}(/|$)|//' then get(transform(array(split(j, '/')), p -> {walk}), 0) else j end), 0)"""
    tail = """concat(case when q <> '' then concat('?', q) else '' end,
                     case when r.fragment <> '' then concat('#', r.fragment) else '' end)"""
    place = f"""get(transform(array({joined}), w -> concat(case when startswith(w, '/') then '' else '/' end, w)), 0)"""
    body = f"""get(transform(array(case when r.path = '' and r.query = '' and not r.placed then b.query else r.query end), q ->
        case when r.text = '' then b.text
             when r.scheme <> '' and r.scheme <> b.scheme then r.text
             when r.placed then concat(b.scheme, '://', r.netloc, r.path, {tail})
             else concat(b.scheme, '://', b.netloc, case when r.path = '' then b.path else {place} end, {tail}) end), 0)"""
    return f"""x -> case when x.base is not null and x.ref is not null then
        get(transform(array(struct(struct(x.base as text, {split('x.base')}) as b,
            struct(x.ref as text, x.ref rlike r'^(?:{_SCHEME}:)?//' as placed, {split('x.ref')}) as r)), y ->
            get(transform(array(y.b), b -> get(transform(array(y.r), r -> {body}), 0)), 0)), 0) end"""


def resolve(base, ref) -> Column:
    """Absolute form of a reference found on the page at ``base`` (RFC 3986, 5.2)."""
    return apply(F.struct(_col(base).alias("base"), _col(ref).alias("ref")), _resolve_sql())
