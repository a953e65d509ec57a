"""Cosine duplicates against all pairs."""

from collections import defaultdict

import numpy as np
import pytest

from weblode.llm import cosine

SHAPE = "vec_id long, embedding array<float>, label int, node long, weight double, h1 string"


def brute(rows):
    """(vec_id, n_links, component) by all pairs, places as nodes."""
    ok, vec = [], []
    for _, v, label in rows:
        fine = v is not None and len(v) > 0 and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ok.append(fine)
        vec.append(np.array(v, np.float32).astype(float) if fine else None)
    n = len(rows)
    links = defaultdict(set)
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(vec[i]) == len(vec[j]):
                a, b = vec[i] / np.abs(vec[i]).max(), vec[j] / np.abs(vec[j]).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        comp = min(ids, default=None)
        out.append((rows[i][0], len(links[i]), comp, rows[i][0] == comp))
    return sorted(out, key=str)


def got(spark, rows):
    return sorted((tuple(r) for r in cosine.groups(spark.createDataFrame([(*r, 1, 0.5, "x") for r in rows], SHAPE)).collect()), key=str)


def test_odd_rows(spark):
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, float("nan")], 1), (6, [1.0, float("inf")], 1), (7, [1.0, 2.0], None),
        (8, [1.0, 2.0], None), (9, [1.0, 2.0], 1), (10, [1.0, 2.0], 2), (11, [1.0, 2.0], 1), (11, [1.0, 2.0], 1), (12, [2.0, 4.0], 1), (13, [-1.0, -2.0], 1),
        (14, [1.0, 2.0, 0.0], 1), (None, [1.0, 2.1], 1), (None, [5.0, -5.0], 1), (15, [0.0, 1e-38], 1), (16, [0.0, 3e38], 1), (17, [-0.0, 1.0], 1), (18, [0.5], 1), (19, [7.0], 1),
        # One id with two vectors that have nothing in common links neither group with the other.
        (20, [1.0, 0.0], 3), (20, [0.0, 1.0], 3), (21, [1.0, 0.01], 3), (19, [0.01, 1.0], 3),
    ]
    assert got(spark, rows) == brute(rows)


def test_empty(spark):
    assert got(spark, []) == []


@pytest.mark.parametrize("block", [1024, 16])
def test_against_all_pairs(spark, monkeypatch, block):
    """Groups of several widths, chains and copies; small blocks too."""
    monkeypatch.setattr(cosine, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        centre, width = rng.normal(size=24), [0.02, 0.1, 0.16, 0.25][g % 4]
        for _ in range(40):
            rows.append((len(rows), (centre + width * rng.normal(size=24)).tolist(), g % 2))
    step = rng.normal(size=(2, 24))
    rows += [(1000 + k, (np.cos(k * 0.19) * step[0] / np.linalg.norm(step[0]) + np.sin(k * 0.19) * step[1] / np.linalg.norm(step[1])).tolist(), 5) for k in range(8)]
    rows += [(2000 + k, rows[k % 3][1], 0) for k in range(60)]
    rows += [(3000 + k, rng.normal(size=24).tolist(), k % 3) for k in range(200)]
    assert got(spark, rows) == brute(rows)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert sorted((tuple(r) for r in cosine.groups(df).collect()), key=str) == brute(rows)


def test_miss_does_not_grow():
    for rows in (10, 10**6, 10**9):
        bits, tables = cosine.plan(rows)
        assert (1 - cosine.agree(cosine.LEAST) ** bits) ** tables <= cosine.MISS
        assert tables < 1 << cosine.TABLE_BITS


def test_signs_do_not_depend_on_the_batch():
    v = np.random.default_rng(1).normal(size=(500, 64)).astype(np.float32).astype(float)
    whole = cosine.codes(v, 16, 22, {})
    for i in (0, 7, 499):
        one = cosine.codes(v[i : i + 1] * 0.25, 16, 22, {})
        assert (one[0][0] == whole[0][i]).all() and one[1][0] == whole[1][i]
