"""Find an element again after a page was redesigned, by a stored fingerprint."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from weblode.functions.text import clean
from weblode.operators import dom


def fingerprints(doms: DataFrame, found: Column, keys: Sequence[str], name: Column) -> DataFrame:
    """(keys, name, tag, print) of matched nodes: tag, parent tag, depth, attributes, text words."""
    rows = doms.select(*keys, name.alias("name"), F.inline(F.transform(found, _shape)))
    return rows


def candidates(doms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every element of the pages in the same shape, with its position."""
    return doms.select(*keys, F.inline(F.transform(F.filter("nodes", dom.is_element), _shape)))


def _shape(n: Column) -> Column:
    parent = F.get(F.col("nodes"), n["parent"])
    pairs = F.coalesce(F.transform(n["attrs"], lambda a: F.concat(a["name"], F.lit("="), a["value"])), F.array().cast("array<string>"))
    return F.struct(
        n["pos"].alias("pos"), n["tag"].alias("tag"), F.coalesce(parent["tag"], F.lit("")).alias("parent_tag"), n["depth"].alias("depth"),
        F.array_sort(F.array_distinct(pairs)).alias("attributes"),
        F.array_distinct(F.split(clean(dom.subtree_text("nodes", n)), " ")).alias("words"),
    )


def _overlap(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(F.lit(1.0))


def relocate(saved: DataFrame, now: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """(keys, name, pos, score): the best element of the same tag for each fingerprint.

    Fingerprints meet only elements of their own page and tag; the best is
    kept by a combining aggregate.
    """
    s = saved.select(*keys, "name", "tag", F.struct("parent_tag", "depth", "attributes", "words").alias("s"))
    j = s.join(now, [*keys, "tag"])
    score = (
        0.4 * _overlap(F.col("s.attributes"), F.col("attributes")) + 0.4 * _overlap(F.col("s.words"), F.col("words"))
        + 0.1 * (F.col("s.parent_tag") == F.col("parent_tag")).cast("double")
        + 0.1 / (1 + F.abs(F.col("s.depth") - F.col("depth")))
    )
    best = j.groupBy(*keys, "name").agg(F.max(F.struct(F.round(score, 6).alias("score"), (-F.col("pos")).alias("back"))).alias("b"))
    return best.filter(F.col("b.score") >= threshold).select(*keys, "name", (-F.col("b.back")).alias("pos"), F.col("b.score").alias("score"))
