"""Columns over decoded JSON records."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from weblode.functions.text import let, strip, unescape


def first_present(*cols) -> Column:
    """First value that is neither null nor empty text."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols])


def replace_pairs(text: Column, pairs: Column) -> Column:
    """Apply (from, to) replacements one after the other."""
    return F.aggregate(
        F.coalesce(pairs, F.array().cast("array<struct<from:string,to:string>>")),
        F.coalesce(text, F.lit("")),
        lambda acc, p: F.when(F.coalesce(p["from"], F.lit("")) == "", acc).otherwise(F.replace(acc, p["from"], p["to"])),
    )


def expanded_text(post: Column) -> Column:
    """A post's text with short links expanded and media links removed."""
    nothing = F.array().cast("array<struct<from:string,to:string>>")
    links = F.transform(
        post["entities"]["urls"],
        lambda u: F.struct(u["url"].alias("from"), F.coalesce(F.nullif(u["expanded_url"], F.lit("")), u["url"]).alias("to")),
    )
    media = F.transform(post["entities"]["media"], lambda m: F.struct(m["url"].alias("from"), F.lit("").alias("to")))
    return strip(unescape(replace_pairs(post["text"], F.concat(F.coalesce(links, nothing), F.coalesce(media, nothing)))))


def best_media(details: Column) -> Column:
    """URL per medium: the mp4 of highest bitrate (the first of equals), else the image."""

    def one(m: Column) -> Column:
        clips = F.filter(m["video_info"]["variants"], lambda v: v["content_type"] == "video/mp4")
        top = F.aggregate(
            clips,
            F.get(clips, F.lit(0)),
            lambda a, v: F.when(F.coalesce(v["bitrate"], F.lit(0)) > F.coalesce(a["bitrate"], F.lit(0)), v).otherwise(a),
        )
        return F.when(F.size(clips) > 0, top["url"]).otherwise(m["media_url_https"])

    return F.filter(F.transform(F.coalesce(details, F.array().cast("array<struct<media_url_https:string,video_info:struct<variants:array<struct<bitrate:bigint,content_type:string,url:string>>>>>")), one), lambda u: u.isNotNull() & (u != ""))


def list_or_text(raw: Column) -> Column:
    """A field that is a JSON list or plain text, as text joined by commas."""
    return F.coalesce(F.when(raw.startswith("["), F.array_join(F.from_json(raw, "array<string>"), ", ")), raw)


def pretty(value: Column) -> Column:
    """A record as indented JSON text."""
    return F.to_json(value, {"pretty": "true"})


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_replace(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", "$1")


def json_list(bodies: Column) -> Column:
    """A list of JSON texts as one JSON text."""
    return F.concat(F.lit("["), F.array_join(bodies, ","), F.lit("]"))


def json_object(pairs: Column) -> Column:
    """A list of (key, body) with JSON bodies as one JSON text."""
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda x: F.concat(_quoted(x["key"]), F.lit(":"), x["body"])), ","), F.lit("}"))


def assembled(**parts: Column) -> Column:
    """One JSON object of JSON texts; parts that are null or empty (``""``, ``[]``, ``{}``) are left out, an object without parts is ``{}``."""
    # A part is named first: it may cost much, and is looked at twice.
    kept = lambda name, part: let(part, lambda p: F.when(~p.isin('""', "[]", "{}", "null"), F.concat(F.lit(f'"{name}":'), p)))
    full = [kept(name, part) for name, part in parts.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *full), F.lit("}"))
