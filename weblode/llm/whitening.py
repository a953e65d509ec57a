"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries become whole numbers x = floor(64 * c) + 1000000; the model is fitted on each distinct x vector once.  Sums and the scatter are added up in tasks
and between them as whole numbers, centred at the mean's nearest whole number before multiplying; the rest of the mean (under a half) is taken off exactly on the driver,
so the covariance does not depend on how rows are dealt out.  P'VP = LL' with the largest remaining diagonal first, which shows the rank; Jacobi
rotations make the columns of L orthogonal: then their squared norms are V's eigenvalues and the normalised columns its eigenvectors.

The driver sees d sums and d * d products, never vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from weblode.llm.common import written

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
#: Rows multiplied at a time.
ROWS = 4096
#: Largest whole number that is exact in a double.
EXACT = 1 << 53


@dataclass
class Model:
    n: int
    sums: list[int]
    components: np.ndarray  # one per column
    values: np.ndarray
    trace: float
    identity_error: float = 0.0


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and components (as doubles) of the vectors that have ``dim`` finite components."""
    at = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dim)
    flat = column.take(pa.array(at, pa.int64())).flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
    fine = np.isfinite(values).all(1)
    return at[fine], values[fine]


def whole(values: np.ndarray) -> np.ndarray:
    """x of components; beyond 2**62 they stay at that bound."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * values), -(2.0**62), 2.0**62).astype(np.int64) + OFFSET


def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    ends = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(values.ravel(), kind))


def dimension(df: DataFrame) -> int:
    """The length that most usable vectors have (of several, the largest); 0 if there are none."""
    top = df.filter(usable("embedding")).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top.d if top else 0


def usable(c: str):
    return F.col(c).isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def whole_vectors(dim: int):
    def run(batches):
        for b in batches:
            at, v = matrix(b.column("embedding"), dim)
            if len(at):
                yield pa.RecordBatch.from_arrays([lists(whole(v), pa.int64())], ["x"])

    return run


def stacked(batches, dim: int):
    """The x vectors of a partition, up to ROWS at a time."""
    for b in batches:
        x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        for i in range(0, len(x), ROWS):
            yield x[i : i + ROWS]


def totals(dim: int):
    """Per partition: rows, sums, least and largest value of each dimension."""

    def run(batches):
        n, s = 0, [0] * dim
        low, high = np.full(dim, np.iinfo(np.int64).max), np.full(dim, np.iinfo(np.int64).min)
        for x in stacked(batches, dim):
            n += len(x)
            # High and low halves, so that no sum leaves 64 bits.
            part = [(int(h) << 32) + int(lo) for h, lo in zip((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), strict=True)]
            s = [a + b for a, b in zip(s, part, strict=True)]
            low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        if n:
            yield pa.RecordBatch.from_pylist([{"n": n, "d": d, "s": str(s[d]), "low": int(low[d]), "high": int(high[d])} for d in range(dim)])

    return run


def products(dim: int, shift: np.ndarray, exact: bool):
    """Per partition: the upper triangle of the sum of z z', z = x - shift; as whole numbers where they all fit a double."""
    upper = np.triu_indices(dim)

    def run(batches):
        total = np.zeros((dim, dim), np.int64 if exact else float)
        some = False
        for x in stacked(batches, dim):
            z = (x - shift).astype(float)
            p = z.T @ z
            total += p.astype(np.int64) if exact else p
            some = True
        if some:
            flat = total[upper]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["at", "v"])

    return run


def covariance(fit: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, covariance with divisor n) of written x vectors."""
    parts = fit.mapInArrow(totals(dim), "n long, d long, s string, low long, high long")
    whole_sum = F.sum(F.col("s").cast("decimal(38,0)"))
    found = parts.groupBy("d").agg(F.sum("n").alias("n"), whole_sum.alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()
    n, sums = found[0].n, [int(r.s) for r in found]
    shift = [(2 * s + n) // (2 * n) for s in sums]
    wide = max(max(r.high - m, m - r.low) for r, m in zip(found, shift, strict=True))
    exact = wide * wide * ROWS < EXACT and wide * wide * n < 1 << 62
    scatter = fit.mapInArrow(products(dim, np.array(shift, np.int64), exact), f"at int, v {'long' if exact else 'double'}").groupBy("at").agg(F.sum("v").alias("v"))
    flat = {r["at"]: r.v for r in scatter.collect()}
    rest = [s - n * m for s, m in zip(sums, shift, strict=True)]
    v = np.zeros((dim, dim))
    for at, (i, j) in enumerate(zip(*np.triu_indices(dim), strict=True)):
        v[i, j] = v[j, i] = (n * flat[at] - rest[i] * rest[j]) / (n * n)
    return n, sums, v


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with a[order][:, order] = L L'; L has as many columns as ``a`` has rank."""
    d = len(a)
    order, left, low = np.arange(d), a.diagonal().copy(), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    for k in range(d):
        p = k + int(left[k:].argmax())
        if left[p] <= least:
            return low[:, :k], order
        for x in (order, left, low):
            x[[k, p]] = x[[p, k]]
        low[k, k] = np.sqrt(left[k])
        low[k + 1 :, k] = (a[order[k + 1 :], order[k]] - low[k + 1 :, :k] @ low[k, :k]) / low[k, k]
        left[k + 1 :] -= low[k + 1 :, k] ** 2
    return low, order


def rounds(n: int):
    """All pairs of n columns, in rounds of pairs that share no column."""
    ring = [*range(n), *([-1] if n % 2 else [])]
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[: len(ring) // 2], ring[::-1], strict=False) if a >= 0 and b >= 0]
        yield np.array([min(p) for p in pairs], int), np.array([max(p) for p in pairs], int)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def one_sided_jacobi(u: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Rotate the columns until they are orthogonal to double precision."""
    u = u.copy()
    eps = np.finfo(float).eps
    for _ in range(sweeps):
        worst = 0.0
        for i, j in rounds(u.shape[1]):
            a, b = u[:, i], u[:, j]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            off = np.abs(ab) / np.sqrt(aa * bb)
            worst = max(worst, off.max(initial=0.0))
            turn = off > eps
            zeta = (bb - aa) / np.where(turn, 2 * ab, 1.0)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            u[:, i], u[:, j] = c * a - c * t * b, c * t * a + c * b
        if worst <= 4 * eps:
            break
    return u


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns, the entry of largest size positive) of the positive part of a covariance."""
    low, order = pivoted_cholesky(v)
    turned = one_sided_jacobi(low)
    norms = np.sqrt((turned * turned).sum(0))
    by = np.argsort(-norms, kind="stable")
    out = np.zeros((len(v), len(by)))
    out[order] = turned[:, by] / norms[by]
    sign = np.sign(out[np.abs(out).argmax(0), np.arange(len(by))]) if len(by) else np.ones(0)
    return norms[by] ** 2, out * sign


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly (Python's whole numbers where 64 bits may not do)."""
    s = np.array(sums, object)
    wide = max(abs(n * int(m) - int(t)) for part in (x.min(0), x.max(0)) for m, t in zip(part, sums, strict=True))
    big = max(n * max(abs(int(x.min())), abs(int(x.max()))), max(map(abs, sums)), wide)
    return n * x - s.astype(np.int64) if big < 1 << 63 else n * x.astype(object) - s


def projected(x: np.ndarray, m: Model) -> np.ndarray:
    return (centred(x, m.n, m.sums) / m.n).astype(float) @ m.components / np.sqrt(m.values)


def whitened_products(dim: int, m: Model):
    k = len(m.values)

    def run(batches):
        total, some = np.zeros((k + 1, k)), False
        for x in stacked(batches, dim):
            w = projected(x, m)
            total[:k] += w.T @ w
            total[k] += w.sum(0)
            some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["at", "v"])

    return run


def fitted(df: DataFrame, most: int = COMPONENTS) -> tuple[int, Model] | None:
    """(dimension, model) of the vectors in ``embedding``; None without usable vectors.  Components with eigenvalue 0 are left out."""
    dim = dimension(df)
    if not dim:
        return None
    fit = written(df.select("embedding").mapInArrow(whole_vectors(dim), "x array<long>").distinct(), "fit")
    n, sums, v = covariance(fit, dim)
    values, vectors = components(v)
    m = Model(n, sums, vectors[:, :most], values[:most], float(v.trace()))
    k = len(m.values)
    if k:
        rows = fit.mapInArrow(whitened_products(dim, m), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
        t = np.zeros((k + 1) * k)
        t[[r["at"] for r in rows]] = [r.v for r in rows]
        t = t.reshape(k + 1, k) / n
        m.identity_error = float(np.abs(t[:k] - np.outer(t[k], t[k]) - np.eye(k)).max())
    return dim, m


def whitened(df: DataFrame, dim: int, m: Model) -> DataFrame:
    """(vec_id, x, deviation, whitened) of every usable vector of ``dim`` components."""

    def run(batches):
        for b in batches:
            at, v = matrix(b.column("embedding"), dim)
            for i in range(0, len(at), ROWS):
                x = whole(v[i : i + ROWS])
                c = centred(x, m.n, m.sums)
                most = max(int(abs(c.min())), int(abs(c.max())))
                c = c if most * most * dim < 1 << 63 else c.astype(object)
                dev = (c * c).sum(1)
                dev = pa.array([d if d < 1 << 63 else None for d in dev.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id").take(pa.array(at[i : i + ROWS])), lists(x, pa.int64()), dev, lists(projected(x, m), pa.float64())], ["vec_id", "x", "deviation", "whitened"]
                )

    return df.select("vec_id", "embedding").mapInArrow(run, "vec_id long, x array<long>, deviation long, whitened array<double>")


def rows(df: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Dropped are vectors that are null, empty, hold null or non-finite entries, or have another length than most of the usable ones (of equally many, the longest
    counts).  Repeated rows and ids come out repeated; they are fitted once.  Vectors that are all equal have no component and so no rows.  A deviation beyond 64 bits is
    null.  An empty table gives no rows.  Other columns are ignored.
    """
    shape = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = fitted(df, most)
    if not found or not len(found[1].values):
        return df.sparkSession.createDataFrame([], shape)
    dim, m = found
    shares = F.array(*[F.lit(float(e) / m.trace) for e in m.values])
    out = whitened(df, dim, m).select("vec_id", "deviation", F.posexplode("whitened").alias("_i", "whitened"))
    return out.select(
        "vec_id", (F.col("_i") + 1).cast("int").alias("component"), F.lit(m.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("_i")).alias("explained"),
        F.lit(m.identity_error).alias("identity_error"),
    )
