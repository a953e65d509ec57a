"""The manifest against a plain tree, and its SQL."""

import hashlib
import zlib

import duckdb
import pytest
from oddities import ROWS

from weblode.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(digests, fan):
    """(root, path of every leaf)."""
    paths, at, nodes = [[] for _ in digests], list(range(len(digests))), digests
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = i // fan * fan
            paths[leaf].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + fan])))
            at[leaf] = i // fan
        nodes = [h(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
    return nodes[0], paths


def plain(rows, fan=2):
    """rows: doc_id, text, lang, source, n_chars"""
    groups = {}
    for i, text, lang, source, n in rows:
        leaf = h(*map(field, (i, source, lang, n, text)))
        bad = i is not None and zlib.crc32(str(i).encode()) % 7 == 0
        other = h(*map(field, (i, source, lang, None if n is None else n + 1, text))) if bad else leaf
        groups.setdefault(lang, []).append((i is not None, i or 0, leaf, other, i))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    parts = []
    for lang in langs:
        leaves = sorted(groups[lang], key=lambda x: x[:3])
        parts.append((leaves, *tree([x[2] for x in leaves], fan)))
    if not parts:
        return []
    root, tops = tree([p[1] for p in parts], fan)
    out = []
    for (leaves, subroot, paths), top in zip(parts, tops, strict=True):
        for (_, _, leaf, other, i), path in zip(leaves, paths, strict=True):
            d = other
            for left, right in path + top:
                d = h(left, d, right)
            out.append((i, leaf, subroot, root, h(*[s for side in path + top for s in side]), d, d == root))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, "q", "p") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, slot int, grp string, path string")


def got(spark, rows):
    return sorted((tuple(r) for r in manifest.proofs(manifest.manifest(table(spark, rows))).collect()), key=str)


ODD = [(i, t, lang, src, n) for k, (i, t) in enumerate(ROWS) for lang, src, n in [(("en", None, "", "é", "zz")[k % 5], ("s", None, "")[k % 3], (None, 0, 5)[k % 3])]]


@pytest.mark.parametrize("fan,levels", [(2, 10), (2, 1), (2, 2), (3, 2), (5, 1)])
def test_against_a_plain_tree(spark, monkeypatch, fan, levels):
    """Blocks of any height, so several tiers too; groups of 1, 2, 3 ... rows; odd rows, repeats and null ids."""
    monkeypatch.setattr(manifest, "FAN", fan)
    monkeypatch.setattr(manifest, "LEVELS", levels)
    rows = ODD + [(100 * g + k, f"text {k}", f"l{g}", "s", k) for g, n in enumerate((1, 2, 3, 4, 5, 8, 9, 17)) for k in range(n)]
    assert got(spark, rows) == plain(rows, fan)


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", "s", 1)], [(7, None, None, None, None)] * 3])
def test_small(spark, rows):
    assert got(spark, rows) == plain(rows)


def test_tampering_shows(spark):
    out = got(spark, [(k, "t", "en", "s", k) for k in range(60)])
    bad = {k for k in range(60) if zlib.crc32(str(k).encode()) % 7 == 0}
    assert bad and {r[0] for r in out if not r[-1]} == bad


def test_sql(spark):
    rows = [r for r in ODD if "\x00" not in (r[1] or "")]  # DuckDB ends texts at a zero character
    pdf = table(spark, rows).toPandas()
    con = duckdb.connect()
    con.register("documents_", pdf)
    con.execute("create view documents as select cast(doc_id as bigint) as doc_id, text, lang, source, cast(n_chars as bigint) as n_chars from documents_")
    rel = con.execute(manifest.sql())
    assert [d[0] for d in rel.description] == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(rel.fetchall(), key=str) == got(spark, rows)
