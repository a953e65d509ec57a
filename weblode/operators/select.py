"""Selectors as data: steps, values and row rules over the node array.

A selector is a list of alternatives, each a list of ``Step``s.  A step says
what a node must look like and how it hangs below the previous one.  Rules
are plain values, so one job can run the rule sets of many sites.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from weblode.functions.text import clean
from weblode.functions.urls import resolve
from weblode.operators import dom


@dataclass(frozen=True)
class Step:
    """One compound selector: ``tag#id.class[attr op value]:nth-child(n)``.

    ``attrs`` holds (name, op, value) with op one of ``has = ^= *= $= not``;
    ``child`` asks for a direct child of the previous step's match.
    """

    tag: str | None = None
    id: str | None = None
    classes: tuple[str, ...] = ()
    attrs: tuple[tuple[str, str, str | None], ...] = ()
    nth: int | None = None
    child: bool = False


@dataclass(frozen=True)
class Pick:
    """What to take from a page or row element.

    ``paths`` are alternatives in page order; without any, the row element
    itself is meant.  ``take`` is ``text`` (whole subtree), ``own`` (direct
    text nodes, one value each) or ``attr:NAME``; ``href`` and ``src`` come
    out absolute.
    """

    paths: tuple[tuple[Step, ...], ...] = ()
    take: str = "text"


@dataclass(frozen=True)
class Field:
    name: str
    pick: Pick
    many: bool = False


def _test_attr(n: Column, name: str, op: str, value: str | None) -> Column:
    found = dom.attribute(n, name)
    if op == "has":
        return found.isNotNull()
    if op == "not":
        return found.isNull()
    tests = {
        "=": lambda: found == value,
        "^=": lambda: found.startswith(value),
        "*=": lambda: found.contains(value),
        "$=": lambda: found.endswith(value),
    }
    return F.coalesce(tests[op](), F.lit(False))


def matches(step: Step, n: Column) -> Column:
    """Does the node look like the step says?  Cheap tests come first."""
    test = dom.is_element(n)
    if step.tag and step.tag != "*":
        test = test & (n["tag"] == step.tag)
    if step.nth is not None:
        test = test & (n["nth"] == step.nth)
    if step.id is not None:
        test = test & _test_attr(n, "id", "=", step.id)
    if step.classes:
        words = F.split(F.coalesce(dom.attribute(n, "class"), F.lit("")), r"\s+")
        for c in step.classes:
            test = test & F.array_contains(words, c)
    for name, op, value in step.attrs:
        test = test & _test_attr(n, name, op, value)
    return test


def _at(nodes: Column, places: Column) -> Column:
    """Nodes at the given positions, each once, in page order."""
    return F.transform(F.array_sort(F.array_distinct(places)), lambda p: F.get(nodes, p))


def _below(nodes: Column, found: Column, step: Step) -> Column:
    """Matches of a step under the given nodes.

    Nested starting points find the same node again; positions, not whole
    nodes, are compared to keep it once.
    """

    def under(a: Column) -> Column:
        hit = lambda d: matches(step, d) & ((d["parent"] == a["pos"]) if step.child else F.lit(True))
        return F.transform(F.filter(dom.inside(nodes, a), hit), lambda d: d["pos"])

    return _at(nodes, F.flatten(F.transform(found, under)))


def select(nodes, path: Sequence[Step], root: Column | None = None) -> Column:
    """Nodes matching a path of steps, below ``root`` when one is given."""
    nodes = F.col(nodes) if isinstance(nodes, str) else nodes
    scope = nodes if root is None else dom.inside(nodes, root)
    found = F.filter(scope, lambda n: matches(path[0], n))
    for step in path[1:]:
        found = _below(nodes, found, step)
    return found


def select_any(nodes, paths: Sequence[Sequence[Step]], root: Column | None = None) -> Column:
    """A comma list: the union of several paths, in page order."""
    nodes = F.col(nodes) if isinstance(nodes, str) else nodes
    found = [select(nodes, p, root) for p in paths]
    if len(found) == 1:
        return found[0]
    return _at(nodes, F.concat(*[F.transform(f, lambda n: n["pos"]) for f in found]))


def values(nodes, pick: Pick, base, root: Column | None = None) -> Column:
    """Cleaned, non-empty values in page order."""
    nodes = F.col(nodes) if isinstance(nodes, str) else nodes
    base = F.col(base) if isinstance(base, str) else base
    found = select_any(nodes, pick.paths, root) if pick.paths else F.array(root)
    if pick.take.startswith("attr:"):
        name = pick.take[5:]
        got = F.transform(found, lambda n: clean(dom.attribute(n, name)))
        if name in ("href", "src"):
            got = F.transform(F.filter(got, lambda v: v != ""), lambda v: resolve(base, v))
    elif pick.take == "own":
        got = F.transform(F.flatten(F.transform(found, lambda n: dom.own_texts(nodes, n))), clean)
    else:
        got = F.transform(found, lambda n: clean(dom.subtree_text(nodes, n)))
    return F.filter(got, lambda v: v.isNotNull() & (v != ""))


def pages_with(pages: DataFrame, paths: Sequence[Sequence[Step]]) -> Column:
    """Boolean column: does the page hold a match?"""
    return F.size(select_any("nodes", paths)) > 0


def row_array(fields: Sequence[Field], each: Sequence[Sequence[Step]] | None = None, base: str = "url", limit: int = 0) -> Column:
    """The rows of a page as an array of structs with the given fields."""

    def row(root: Column | None) -> Column:
        cells = []
        for f in fields:
            got = values("nodes", f.pick, base, root)
            cells.append((got if f.many else F.get(got, F.lit(0))).alias(f.name))
        return F.struct(*cells)

    def filled(r: Column) -> Column:
        test = F.lit(False)
        for f in fields:
            test = test | ((F.size(r[f.name]) > 0) if f.many else r[f.name].isNotNull())
        return test

    if each is None:
        rows = F.array(row(None))
    else:
        rows = F.filter(F.transform(select_any("nodes", each), row), filled)
    return F.slice(rows, 1, limit) if limit else rows


def extract_rows(
    doms: DataFrame,
    fields: Sequence[Field],
    each: Sequence[Sequence[Step]] | None = None,
    keep: Sequence[str] = ("url",),
    base: str = "url",
    limit: int = 0,
) -> DataFrame:
    """Rule-driven rows: one per ``each`` match, or one per page without it.

    A plain field is the first value or null, a ``many`` field the whole
    list.  With ``each``, a match none of whose fields has a value is no row.
    ``_row`` numbers the rows of a page from 1; ``limit`` keeps the first n.
    """
    return numbered(doms, row_array(fields, each, base, limit), [f.name for f in fields], keep)


def numbered(doms: DataFrame, rows: Column, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One line per struct of an array column, numbered from 1."""
    out = doms.select(*keep, F.posexplode(rows).alias("_row", "_cells"))
    return out.select(*keep, (F.col("_row") + 1).alias("_row"), *[F.col("_cells")[name].alias(name) for name in names])
