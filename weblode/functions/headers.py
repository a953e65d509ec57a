"""Header, cookie and media-type columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from weblode.functions.text import strip


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _last_wins(entries: Column) -> Column:
    """Array of (key, value) to a map; a later pair replaces an earlier one."""
    n = F.size(entries)
    kept = F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda later: later["key"] == e["key"]),
    )
    return F.map_from_entries(kept)


def header_map(lines) -> Column:
    """Array of ``Key: value`` lines to a map; lines without a colon are left out."""
    entries = F.transform(
        F.filter(_col(lines), lambda h: F.instr(h, ":") > 0),
        lambda h: F.struct(
            strip(F.substring_index(h, ":", 1)).alias("key"),
            strip(F.regexp_extract(h, r"(?s)^[^:]*:(.*)$", 1)).alias("value"),
        ),
    )
    return _last_wins(entries)


def bad_headers(lines) -> Column:
    """The lines a header list must not hold."""
    return F.filter(_col(lines), lambda h: F.instr(h, ":") == 0)


def cookie_map(text) -> Column:
    """``a=1; b=2`` to a map; pieces without ``=`` are dropped."""
    entries = F.transform(
        F.filter(F.split(F.coalesce(_col(text), F.lit("")), ";"), lambda p: F.instr(p, "=") > 0),
        lambda p: F.struct(
            strip(F.substring_index(p, "=", 1)).alias("key"),
            strip(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("value"),
        ),
    )
    return _last_wins(entries)


def media_type_of(value) -> Column:
    """``Text/HTML; charset=utf-8`` -> ``text/html``."""
    return F.lower(strip(F.substring_index(_col(value), ";", 1)))


def media_type(headers) -> Column:
    """Media type of a header map, whatever the case of its keys; empty when absent."""
    hits = F.filter(F.map_entries(_col(headers)), lambda e: F.lower(e["key"]) == "content-type")
    return F.coalesce(media_type_of(F.get(hits, F.lit(0))["value"]), F.lit(""))


def file_extension(media) -> Column:
    """Extension for a body that is stored as bytes."""
    m = _col(media)
    sub = F.substring_index(F.substring_index(m, "/", -1), "+", 1)
    plain = F.left(F.regexp_replace(sub, "[^a-z0-9]", ""), F.lit(8))
    return (
        F.when(m == "application/pdf", F.lit("pdf"))
        .when(m == "application/zip", F.lit("zip"))
        .otherwise(F.coalesce(F.nullif(plain, F.lit("")), F.lit("bin")))
    )
