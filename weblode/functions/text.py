"""Text columns: whitespace, entities, number and time text, Markdown tidying."""

from __future__ import annotations

import html.entities
from functools import lru_cache

from pyspark.sql import Column, functions as F

# Fixed value: the characters Python treats as whitespace, spelled out so that
# Java, RE2 and Python agree on them.
WHITESPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# Fixed value: code points that take no room on screen.
ZERO_WIDTH = "​‌‍⁠﻿"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The same characters one by one, for trimming without a regular expression.
_BLANKS = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())


def let(value: Column, body) -> Column:
    """Name a value inside an expression, so that it is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c) -> Column:
    """Trim all Unicode whitespace at both ends."""
    return F.btrim(_col(c), F.lit(_BLANKS))


def clean(c) -> Column:
    """Collapse every whitespace run to one blank, then trim."""
    return F.trim(F.regexp_replace(_col(c), rf"[{WHITESPACE}]+", " "))


def drop_zero_width(c) -> Column:
    return F.translate(_col(c), ZERO_WIDTH, "")


def presence(c) -> Column:
    """Empty text counts as missing."""
    return F.nullif(_col(c), F.lit(""))


@lru_cache(maxsize=1)
def _entity_tables() -> tuple[dict[str, str], list[str]]:
    """Named characters by rule: the HTML5 list that ships with Python.

    Returns the names that need a semicolon and the older ones that do not
    (longest first, so that a prefix search finds the longest).
    """
    named, loose = {}, []
    for name, char in html.entities.html5.items():
        if name.endswith(";"):
            named[name[:-1]] = char
        else:
            loose.append(name)
    return named, sorted(loose, key=len, reverse=True)


# The handful that make up nearly all entities on real pages; tested before
# the long table.
_COMMON = ("amp", "lt", "gt", "quot", "nbsp", "apos", "copy", "middot")


def apply(value: Column, sql_lambda: str) -> Column:
    """Apply a SQL lambda (``x -> ...``) to a column, computing the argument once."""
    return F.get(F.call_function("transform", F.array(value), F.expr(sql_lambda)), F.lit(0))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@lru_cache(maxsize=1)
def _unescape_sql() -> str:
    named, loose = _entity_tables()
    table = f"str_to_map({_quoted(chr(2).join(k + chr(1) + v for k, v in named.items()))}, '\\u0002', '\\u0001')"
    # Numbers 128 to 159 mean what Windows-1252 has there.
    legacy = "".join(bytes([i]).decode("cp1252", "replace") for i in range(0x80, 0xA0))
    bad = "v is null or v = 0 or v between 55296 and 57343 or v > 1114111"
    number = f"""get(transform(array(regexp_replace(n, '^#([xX]?)0+', '#$1')), m -> get(transform(array(case when length(m) > 12 then 1114112
        when lower(substr(m, 2, 1)) = 'x' then try_cast(conv(substr(m, 3), 16, 10) as bigint)
        else try_cast(substr(m, 2) as bigint) end), v ->
        case when {bad} then '\\uFFFD'
             when v between 128 and 159 and substr('{legacy}', cast(v - 127 as int), 1) <> '\\uFFFD'
             then substr('{legacy}', cast(v - 127 as int), 1)
             else decode(unhex(lpad(hex(v), 8, '0')), 'UTF-32') end), 0)), 0)"""
    common = " ".join(f"when n = '{k}' then {_quoted(named[k])}" for k in _COMMON)
    # Older names also count without a semicolon, the longest that fits.
    prefix = f"""get(transform(array(regexp_extract(s, '^({"|".join(loose)})', 1)), o ->
        case when o = '' then concat('&', s) else concat({table}[o], substr(s, length(o) + 1)) end), 0)"""
    piece = f"""get(transform(array(regexp_extract(s, '^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*)', 1)), n ->
        case when n = '' then concat('&', s)
             when startswith(n, '#') then concat({number}, substr(s, length(n) + case when substr(s, length(n) + 1, 1) = ';' then 2 else 1 end))
             when substr(s, length(n) + 1, 1) = ';'
             then coalesce(concat(case {common} else {table}[n] end, substr(s, length(n) + 2)), {prefix})
             else {prefix} end), 0)"""
    return f"""x -> case when instr(x, '&') > 0 then get(transform(array(split(x, '&')), p ->
        concat(p[0], array_join(transform(slice(p, 2, size(p) - 1), s -> {piece}), ''))), 0) else x end"""


def unescape(c) -> Column:
    """Decode HTML entities in one pass, so ``&amp;lt;`` stays ``&lt;``."""
    return apply(_col(c), _unescape_sql())


def strip_html(c) -> Column:
    """Markup to plain text: tags become blanks, entities are decoded."""
    return clean(unescape(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"<[^>]+>", " ")))


def clock(seconds) -> Column:
    """``75`` -> ``1:15``; ``3675`` -> ``1:01:15``."""
    s = F.floor(_col(seconds)).cast("long")
    h, m, sec = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, sec)).otherwise(F.format_string("%d:%02d", m, sec))


def thousands(n) -> Column:
    return F.format_number(_col(n).cast("long"), 0)


def day_text(c) -> Column:
    """``yyyymmdd`` gets dashes; any other text is left alone."""
    d = _col(c)
    return F.when(
        F.length(d) == 8,
        F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2)),
    ).otherwise(d)


def cut(c, n: int, mark: str = "") -> Column:
    """First ``n`` characters, with a mark when something was cut off."""
    text = _col(c)
    if not mark:
        return F.left(text, F.lit(n))
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.left(text, F.lit(n))), F.lit(mark))).otherwise(text)


def emails(c) -> Column:
    """Distinct e-mail addresses, lower-cased and sorted."""
    found = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"([a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,})"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def locale_label(c) -> Column:
    """``es_ES.UTF-8`` -> ``es-ES``; null when the text is no locale."""
    pattern = r"^([a-z]{2,3})[_-]([A-Z]{2})"
    label = F.concat(F.regexp_extract(_col(c), pattern, 1), F.lit("-"), F.regexp_extract(_col(c), pattern, 2))
    return F.when(_col(c).rlike(pattern), label)


# Fixed values below: what counts as blank lines, a data URI, an image and a link in Markdown.
def squeeze_markdown(c) -> Column:
    """No blanks at line ends, at most one empty line, one newline at the end."""
    text = F.regexp_replace(_col(c), r"[ \t]+\n", "\n")
    return F.concat(strip(F.regexp_replace(text, r"\n{3,}", "\n\n")), F.lit("\n"))


def shorten_data_uris(c) -> Column:
    return F.regexp_replace(_col(c), r"\(data:[^)\s]{40,}\)", "(data:…)")


def tidy_markdown(c, base: Column | None = None) -> Column:
    """Short data URIs, absolute links (when a base is given), squeezed blanks."""
    from weblode.functions.urls import resolve

    text = shorten_data_uris(c)
    if base is not None:
        parts = F.split(text, r"\]\(")
        target = lambda p: F.regexp_extract(p, r"^([^)\s]+)", 1)
        absolute = F.transform(
            F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
            lambda p: F.when(
                (target(p) == "") | p.startswith("#") | p.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), p
            ).otherwise(F.concat(resolve(base, target(p)), F.substr(p, F.length(target(p)) + F.lit(1)))),
        )
        rebuilt = F.concat_ws("](", F.concat(F.array(F.element_at(parts, 1)), absolute))
        text = F.when(F.instr(text, "](") > 0, rebuilt).otherwise(text)
    return squeeze_markdown(text)


def compact_markdown(c) -> Column:
    """Images dropped, links reduced to their text (one nested pair of parentheses)."""
    text = F.regexp_replace(shorten_data_uris(c), r"!\[[^\]]*\]\([^)]*\)", "")
    text = F.regexp_replace(text, r"\[([^\]]*)\]\((?:[^()]++|\([^)]*+\))*+\)", "$1")
    return squeeze_markdown(text)
