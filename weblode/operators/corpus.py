"""The corpus: body kinds, compaction, index, search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from weblode.functions.text import clean, strip, thousands
from weblode.operators.platforms import FEED_ROOT


def body_kind(media: Column, text: Column) -> Column:
    """html, json, feed, xml, text or binary, from media type and first characters."""
    html = media.contains("html") | ((media == "") & F.lower(F.left(text, F.lit(2000))).contains("<html"))
    json_like = media.contains("json") | F.left(text, F.lit(1)).isin("{", "[")
    xml_like = media.contains("xml") | strip(F.left(text, F.lit(2000))).startswith("<?xml")
    feed = F.left(text, F.lit(3000)).rlike(FEED_ROOT)
    return (
        F.when(html, F.lit("html"))
        .when(json_like & F.try_parse_json(text).isNotNull(), F.lit("json"))
        .when(xml_like & feed, F.lit("feed"))
        .when(xml_like, F.lit("xml"))
        .when(media.startswith("text/"), F.lit("text"))
        .when(media != "", F.lit("binary"))
        .otherwise(F.lit("html"))
    )


def preview(text: Column, limit: int = 40_000) -> list[Column]:
    """Shortened text beside the full one, and whether anything was cut."""
    return [
        F.when(F.length(text) > limit, F.rtrim(F.left(text, F.lit(limit)))).otherwise(text).alias("preview"),
        (F.length(text) > limit).alias("was_cut"),
    ]


def csv_ready(rows: DataFrame) -> DataFrame:
    """List columns joined by ``; ``, as a CSV file needs them."""
    return rows.select(*[
        F.array_join(f.name, "; ").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in rows.schema.fields
    ])


def merge_rows(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of several rule sets in one table; columns in first-seen order, gaps null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def compact(records: DataFrame, key: str = "url", seq: str = "line_no") -> DataFrame:
    """The last record of each key, with the place where the key was first seen."""
    rest = [c for c in records.columns if c not in (key, seq)]
    g = records.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r"), F.min(seq).alias("first_seen"))
    return g.select(key, "first_seen", "r.*")


def index_line(title: Column, url: Column, text: Column) -> Column:
    name = F.coalesce(F.nullif(clean(title), F.lit("")), url)
    return F.concat(F.lit("- ["), name, F.lit("]("), url, F.lit(") · "), thousands(F.length(text)), F.lit(" characters"))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def search(docs: DataFrame, terms: Sequence[str], text: str = "text", top: int = 10, keep: Sequence[str] = ("doc_id",),
           k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Documents ranked by BM25 for a few terms.

    Term counts are taken in the row, so nothing but one line of totals and
    the best ``top`` rows leaves a task.
    """
    terms = [t.lower() for t in terms]
    d = docs.select(*keep, words(F.col(text)).alias("_w"))
    tf = [(F.size("_w") - F.size(F.array_remove("_w", t))).alias(f"_tf{i}") for i, t in enumerate(terms)]
    d = d.select(*keep, F.size("_w").alias("_n"), *tf)
    totals = d.agg(
        F.count("*").alias("_docs"), F.avg("_n").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))]
    )
    hit = F.lit(False)
    for i in range(len(terms)):
        hit = hit | (F.col(f"_tf{i}") > 0)
    j = d.filter(hit).crossJoin(totals)  # the one row of a global aggregate
    score = F.lit(0.0)
    for i in range(len(terms)):
        t, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.log(1 + (F.col("_docs") - df + 0.5) / (df + 0.5))
        score = score + idf * t * (k1 + 1) / (t + k1 * (1 - b + b * F.col("_n") / F.col("_avg")))
    ranked = j.select(*keep, F.round(score, 6).alias("score"))
    return ranked.orderBy(F.desc("score"), *keep).limit(top)


def sizes(rows: DataFrame, domain: Column, host: Column, chars: Column) -> DataFrame:
    """Pages and characters per domain and host, with subtotals."""
    return rows.select(domain.alias("domain"), host.alias("host"), chars.alias("chars")).rollup("domain", "host").agg(
        F.count("*").alias("pages"), F.sum("chars").alias("characters")
    )
