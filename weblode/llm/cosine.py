"""Near-duplicate embeddings: random-hyperplane signs in several tables, exact cosines, connected components.

1. Equal vectors of one label form one class, so copies are never compared; a class counts as many vectors as it has rows.
2. Each table gives a class ``bits`` signs of random hyperplanes; a pair at angle t agrees in all of them with probability (1 - t / pi) ** bits.  ``plan``
   takes as many tables as miss a pair at cosine 0.98 with probability ``MISS`` at most, so the miss does not change with the size of the data.
3. (bucket, class, 64 more signs) rows are dealt out by range, so a large bucket spans partitions.  A class that no other of its bucket comes near
   by the 64 signs leaves the bucket; classes of buckets that reach over a batch's border all stay.  No vector moves in this step.
4. Those left get their vectors.  A bucket of more than ``BLOCK`` classes is cut into blocks, and every two blocks meet in a run of rows of their own.  Cosines are
   exact, in doubles.  A pair in several tables counts in the first table it shares.  Out come, per class and run, the number of vectors linked and the
   smallest class connected with it there: rows, not pairs.
5. Components of classes by large-star and small-star steps.

Signs come from whole numbers whose sums are exact in doubles, so every task finds the same signs for a vector.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from weblode.llm.common import mix64, written
from weblode.llm.neardup import components

LEAST = 0.98
MISS = 1e-4
#: Signs of the sketch, and how many may differ: at cosine 0.98 they differ with probability 0.064 each; more than 20 of 64 come with one of 1e-9.
SKETCH, APART = 64, 20
BLOCK = 1024
SEED = 5
TABLE_BITS = 7


def agree(cosine: float) -> float:
    """Probability that two vectors lie on the same side of a random hyperplane."""
    return 1 - math.acos(cosine) / math.pi


def plan(rows: int) -> tuple[int, int]:
    """(bits, tables): buckets of 64 rows at most on average over evenly spread vectors, and no more than ``MISS`` pairs at the limit lost."""
    bits = min(max(16, math.ceil(math.log2(max(rows, 1) / 64))), 28)
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree(LEAST) ** bits))


def planes(dim: int, n: int) -> np.ndarray:
    """n normals of ``dim`` whole numbers, near a normal distribution; the same in every process."""
    at = np.arange(dim * n, dtype=np.uint64) + np.uint64(SEED << 32)
    eight = mix64(mix64(at) + np.uint64(dim)).view(np.uint8).reshape(-1, 8).astype(np.int64)
    return (eight.sum(1) - 1020).reshape(dim, n).astype(float)


def signs(vectors: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """Side of each hyperplane, from entries rounded to 2**20 steps of the vector's largest one: all sums are exact in doubles."""
    steps = np.rint(vectors / np.abs(vectors).max(1, keepdims=True) * (1 << 20))
    return steps @ normals >= 0


def packed(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``width`` signs each as whole numbers."""
    return (bits.reshape(len(bits), -1, width) * (np.uint64(1) << np.arange(width, dtype=np.uint64))).sum(2, dtype=np.uint64)


def codes(vectors: np.ndarray, bits: int, tables: int, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """(code of each table, sketch) of vectors of one length; ``known`` keeps the hyperplanes of a task."""
    dim = vectors.shape[1]
    if dim not in known:
        known[dim] = planes(dim, bits * tables + SKETCH)
    s = signs(vectors, known[dim])
    return packed(s[:, : bits * tables], bits), packed(s[:, bits * tables :], SKETCH)[:, 0]


def by_length(column: pa.Array):
    """(places, double matrix) of the vectors of each length."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield at, column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), d)


def dealt(bits: int, tables: int):
    """Per class one row (bucket, node, sketch) a table; a bucket's upper bits are the table."""

    def run(batches):
        known: dict[int, np.ndarray] = {}
        for b in batches:
            node, label = b.column("node").to_numpy(), b.column("label").cast(pa.int64()).to_numpy()
            for at, v in by_length(b.column("embedding")):
                for i in range(0, len(at), 2048):
                    some = at[i : i + 2048]
                    code, sketch = codes(v[i : i + 2048], bits, tables, known)
                    with np.errstate(over="ignore"):
                        key = mix64(mix64(label[some].astype(np.uint64) + np.uint64(v.shape[1]) * np.uint64(0x9E3779B97F4A7C15))[:, None] + code)
                    key = (key >> np.uint64(TABLE_BITS)) | (np.arange(tables, dtype=np.uint64) << np.uint64(64 - TABLE_BITS))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(node[some], tables)), pa.array(np.repeat(sketch, tables).view(np.int64))], ["bucket", "node", "sketch"]
                    )

    return run


def near(batches):
    """(bucket, node) of sorted rows that may have a partner in their bucket."""
    for b in batches:
        bucket, node, sketch = (b.column(c).to_numpy() for c in ("bucket", "node", "sketch"))
        n = len(bucket)
        if not n:
            continue
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        sizes = np.diff(np.r_[starts, n])
        run = np.repeat(np.arange(len(starts)), sizes)
        # The first and the last bucket may go on in other batches; large ones are left to the blocks.
        keep = (run == 0) | (run == len(starts) - 1) | (sizes[run] > BLOCK)
        rest = np.flatnonzero(~keep)
        for step in range(1, BLOCK):
            a = rest[rest + step < n]
            a = a[run[a + step] == run[a]]
            if not len(a):
                break
            rest = a
            hit = a[np.bitwise_count((sketch[a] ^ sketch[a + step]).view(np.uint64)) <= APART]
            keep[hit] = True
            keep[hit + step] = True
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(bucket[keep]), pa.array(node[keep])], ["bucket", "node"])


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place connected with each of n places by the links (a, b)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = np.minimum(new, new[new])
        if (new == low).all():
            return low
        low = new


def links(bits: int, tables: int):
    """(node, links, low) of the classes in each run of rows with one (bucket, x, y)."""

    def compare(rows: pa.Table, known: dict):
        bucket, x, y = (rows.column(c)[0].as_py() for c in ("bucket", "x", "y"))
        t = (bucket & 0xFFFFFFFFFFFFFFFF) >> (64 - TABLE_BITS)
        node, label, weight, block = (rows.column(c).to_numpy() for c in ("node", "label", "weight", "block"))
        out = []
        for at, v in by_length(rows.column("embedding").combine_chunks()):
            v = v / np.abs(v).max(1, keepdims=True)
            code = codes(v, bits, tables, known)[0]
            norm = np.sqrt((v * v).sum(1))
            left, right = np.flatnonzero(block[at] == x), np.flatnonzero(block[at] == y)
            counts, heads, tails = np.zeros(len(at), np.int64), [], []
            for i in range(0, len(left), 256):
                rows_i = left[i : i + 256]
                cos = (v[rows_i] @ v[right].T) / (norm[rows_i][:, None] * norm[right])
                p, q = np.nonzero(cos >= LEAST)
                p, q = rows_i[p], right[q]
                fits = (label[at[p]] == label[at[q]]) & (code[p, t] == code[q, t])
                if x == y:
                    fits &= p < q
                p, q = p[fits], q[fits]
                for j in range(0, len(p), 1 << 16):
                    a, b = p[j : j + (1 << 16)], q[j : j + (1 << 16)]
                    first = ~(code[a, :t] == code[b, :t]).any(1)
                    a, b = a[first], b[first]
                    counts += np.bincount(a, weight[at[b]], len(at)).astype(np.int64) + np.bincount(b, weight[at[a]], len(at)).astype(np.int64)
                    heads.append(a)
                    tails.append(b)
            if heads and (some := np.flatnonzero(counts)).size:
                by = np.argsort(node[at], kind="stable")
                place = np.empty(len(at), np.int64)
                place[by] = np.arange(len(at))
                low = joined(len(at), place[np.concatenate(heads)], place[np.concatenate(tails)])
                out.append((node[at[some]], counts[some], node[at[by[low[place[some]]]]]))
        return out

    def run(batches):
        kept, done, known = None, [], {}

        def flush():
            cols = [np.concatenate(c) for c in zip(*done, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["node", "links", "low"])

        for b in batches:
            part = pa.Table.from_batches([b])
            kept = part if kept is None else pa.concat_tables([kept, part])
            keys = [kept.column(c).to_numpy() for c in ("bucket", "x", "y")]
            cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            # The last run may go on in the next batch.
            for s, e in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True) if len(cuts) else ():
                done.extend(compare(kept.slice(s, e - s), known))
            kept = kept.slice(cuts[-1]).combine_chunks() if len(cuts) else kept
            if done:
                yield flush()
        if kept is not None and kept.num_rows:
            done.extend(compare(kept, known))
            if done:
                yield flush()

    return run


def classes_of(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with the two hashes of their class, classes as written: node, h1, h2, label, embedding, weight, rep)."""
    fine = F.col("embedding").isNotNull() & F.col("label").isNotNull()
    fine &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    names = F.when(F.coalesce(fine, F.lit(False)), F.struct(F.xxhash64(F.lit(1), "label", "embedding").alias("h1"), F.xxhash64(F.lit(2), "embedding", "label").alias("h2")))
    rows = df.select("vec_id", "label", "embedding", names.alias("_k")).select("vec_id", "label", "embedding", "_k.h1", "_k.h2")
    found = rows.filter("h1 is not null").groupBy("h1", "h2").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("rep")
    )
    return rows, written(found.withColumn("node", F.monotonically_increasing_id()), "classes")


def linked(classes: DataFrame) -> DataFrame:
    """(node, links, low) as written: parts of the number of vectors of other classes linked with a class, and a class connected with it."""
    bits, tables = plan(classes.count())
    deals = classes.select("node", "label", "embedding").mapInArrow(dealt(bits, tables), "bucket long, node long, sketch long")
    left = written(deals.repartitionByRange("bucket", "node").sortWithinPartitions("bucket", "node").mapInArrow(near, "bucket long, node long"), "near")
    sizes = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    sizes = sizes.select("bucket", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks"))
    rows = left.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), "_blocks").cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.select("bucket", "node", "block", F.least("block", "_other").alias("x"), F.greatest("block", "_other").alias("y"))
    rows = rows.join(classes.select("node", "label", "embedding", "weight"), "node")
    rows = rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    return written(rows.mapInArrow(links(bits, tables), "node long, links long, low long"), "linked")


def groups(df: DataFrame) -> DataFrame:
    """Per vector: vec_id, n_links (other vectors at cosine >= ``LEAST`` under the same label), component_id (smallest vec_id reachable), kept.

    Vectors that are null, empty, zero or hold null or non-finite entries, and those without a label, link with nothing; they are their own component.  Vectors of
    different lengths are never linked.  Repeated rows are vectors of their own and link with each other.  A row without an id takes part, but never
    names a component that has an id; it is kept where its whole component has none.  An empty table gives no rows.  Other columns are ignored.
    """
    rows, classes = classes_of(df)
    parts = linked(classes)
    comps = components(parts.select(F.col("node").alias("a"), F.col("low").alias("b")))
    more = parts.groupBy("node").agg(F.sum("links").alias("links"))
    of = classes.select("h1", "h2", "node", "weight", "rep").join(more, "node", "left").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = of.groupBy("comp").agg(F.min("rep").alias("_least"))
    of = of.join(least, "comp").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "_least", F.lit(True).alias("_in"))
    out = rows.select("vec_id", "h1", "h2").join(of, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("_in"), F.col("_least")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
