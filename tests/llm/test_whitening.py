"""Whitening against a dense eigenvalue solver and exact fractions."""

from fractions import Fraction

import numpy as np
import pytest

from weblode.llm import whitening

SHAPE = "vec_id long, embedding array<float>, label int, x int, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "y") for i, v in rows], SHAPE)


def usable(rows, dim):
    return [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]


def check(spark, rows, dim, most=16):
    out = whitening.rows(table(spark, rows)).collect()
    fine = usable(rows, dim)
    x = [[int(np.floor(64 * c)) + 1000000 for c in v] for _, v in fine]
    fit = sorted({tuple(r) for r in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    z = np.array([[float(Fraction(c) - Fraction(s, n)) for c, s in zip(r, sums, strict=True)] for r in fit])
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > 1e-10 * e[0]).sum()))
    by = {}
    for r in out:
        by.setdefault(r.component, []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    dev = sorted((i, sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True))) for (i, _), r in zip(fine, x, strict=True))
    at = np.array([[float(Fraction(c) - Fraction(s, n)) for c, s in zip(r, sums, strict=True)] for r in x])
    for c in range(1, k + 1):
        assert sorted((r.vec_id, r.deviation) for r in by[c]) == dev
        assert all(r.n == n and abs(r.explained - e[c - 1] / e.sum()) < 1e-9 and r.identity_error < 1e-6 for r in by[c])
        want = sorted((i, w) for (i, _), w in zip(fine, at @ u[:, c - 1] / np.sqrt(e[c - 1]), strict=True))
        mine = sorted((r.vec_id, r.whitened) for r in by[c])
        # Eigenvectors are compared where their eigenvalue stands apart.
        if min([abs(e[c - 1] - o) for i, o in enumerate(e) if i != c - 1], default=1) > 1e-3 * e[0]:
            sign = 1 if np.dot([w for _, w in want], [w for _, w in mine]) > 0 else -1
            assert [i for i, _ in want] == [i for i, _ in mine]
            assert np.allclose([w for _, w in want], [sign * w for _, w in mine], rtol=1e-7, atol=1e-7)


def test_against_dense(spark):
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(20, 20)) * np.linspace(3, 0.2, 20)
    rows = [(i, (rng.normal(size=20) @ mix + 50).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[i % 5][1]) for i in range(300)]
    check(spark, rows, 20)


def test_odd_rows(spark):
    rows = [
        (1, [0.1, 0.2, 0.9]), (1, [0.1, 0.2, 0.9]), (2, [0.5, -0.5, 0.9]), (None, [0.7, 0.1, 0.9]), (3, None), (4, [0.1, None, 0.3]), (5, [0.1, float("nan"), 0.2]),
        (6, [float("-inf"), 0.0, 0.0]), (7, [1.0, 2.0]), (8, []), (9, [-0.3, 0.4, 0.9]),
    ]
    out = whitening.rows(table(spark, rows)).collect()
    # The third dimension never changes: two components only, and the null id comes out.
    assert sorted({r.component for r in out}) == [1, 2] and len(out) == 2 * 5
    assert {r.vec_id for r in out} == {1, 2, None, 9} and {r.n for r in out} == {4}
    check(spark, [r for r in rows if r[0] is not None], 3)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]])
def test_no_components(spark, rows):
    assert whitening.rows(table(spark, rows)).collect() == []


def test_large_entries(spark):
    rows = [(i, [float((i * 7919) % 1000) * 1e9, float(i), 3e30 if i == 5 else 1.0]) for i in range(40)]
    out = whitening.rows(table(spark, rows)).collect()
    assert len(out) >= 40 and any(r.deviation is None for r in out)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    check(spark, [(r.vec_id, r.embedding) for r in df.collect()], 64)


def test_parts():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(30, 12))
    v = a.T @ a / 30
    low, order = whitening.pivoted_cholesky(v)
    assert np.allclose(low @ low.T, v[order][:, order]) and (np.triu(low, 1) == 0).all()
    assert (np.diff(low.diagonal()) <= 0).all()
    turned = whitening.one_sided_jacobi(low)
    g = turned.T @ turned
    assert np.abs(g - np.diag(g.diagonal())).max() < 1e-14 * g.max() * 12
    e, u = whitening.components(v)
    assert np.allclose(v @ u, u * e) and np.allclose(e, np.linalg.eigvalsh(v)[::-1])
    flat = np.outer(a[0], a[0])
    assert whitening.pivoted_cholesky(flat)[0].shape[1] == 1
