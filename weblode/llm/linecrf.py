"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad.  Its features, those of the lines before and after it and the label before it decide; the field is learned
from labelled documents, whose label all their lines take over.  The marginals of the forward-backward pass, weighted by the
lengths of the lines, make a document's share of good text, and a logistic curve fitted on labelled documents aside turns it into a score.

The field is trained on up to ``SHARDS`` shards (of ``SHARD`` documents, while the sample lasts) of a sample of at most about ``PER_LABEL`` documents a label; the shards' weights are averaged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weblode.llm.common import blocks, id_bucket

#: Labelled documents that are learned from, for each label (expected; the bound of the sample).
PER_LABEL = 2000
SHARDS, SHARD = 8, 400
STEPS, RATE, RIDGE = 200, 0.1, 1e-3
LEAST = 0.7
BLOCK_CHARS = 1 << 20

#: Character classes: other, lower-case letter, upper-case letter, digit, blank, end of a sentence or clause, bar, exclamation mark.
OTHER, LOWER, UPPER, DIGIT, BLANK, STOP, BAR, CRY = range(8)
OWN = 12
SIZE = 3 * OWN + 1
TABLE: list[np.ndarray] = []


def kinds() -> np.ndarray:
    if not TABLE:
        t = np.zeros(1 << 16, np.uint8)
        for i in range(1 << 16):
            c = "?" if 0xD800 <= i < 0xE000 else chr(i)
            t[i] = UPPER if c.isupper() else LOWER if c.isalpha() else DIGIT if c.isdigit() else BLANK if c.isspace() else OTHER
        for c, k in ((".", STOP), (",", STOP), (";", STOP), (":", STOP), ("?", STOP), ("'", STOP), ('"', STOP), ("-", STOP), ("|", BAR), ("!", CRY)):
            t[ord(c)] = k
        TABLE.append(t)
    return TABLE[0]


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, lengths of the lines, number of lines of each text)."""
    split = [t.split("\n") for t in texts]
    lines = [x for s in split for x in s]
    size = np.array([len(x) for x in lines])
    cp = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.where(cp < 1 << 16, kinds()[np.minimum(cp, 0xFFFF)], LOWER)
    n = np.bincount(np.repeat(np.arange(len(lines)), size) * 8 + kind, minlength=8 * len(lines)).reshape(-1, 8).astype(float)
    solid = np.maximum(1.0, size - n[:, BLANK])
    alpha = n[:, LOWER] + n[:, UPPER]
    x = np.zeros((len(lines), OWN))
    x[:, 0] = alpha / solid
    x[:, 1] = n[:, UPPER] / np.maximum(1.0, alpha)
    x[:, 2] = n[:, DIGIT] / solid
    x[:, 3] = np.minimum(1.0, 3 * n[:, OTHER] / solid)
    x[:, 4] = np.minimum(1.0, 3 * n[:, STOP] / solid)
    x[:, 5] = np.minimum(1.0, 6 * n[:, BAR] / solid)
    x[:, 6] = np.minimum(1.0, 6 * n[:, CRY] / solid)
    x[:, 7] = np.minimum(1.0, np.log1p(size) / 8)
    same, distinct, length = [], [], []
    for line in lines:
        w = line.split()
        m = len(w)
        same.append(sum(map(eq, w, w[1:])) / (m - 1) if m > 1 else 0.0)
        distinct.append(len(set(w)) / m ** 0.9 if m else 1.0)
        length.append(m)
    x[:, 8], x[:, 9] = same, np.minimum(1.0, distinct)
    x[:, 10] = np.minimum(1.0, solid / np.maximum(1, length) / 16)
    seen = []
    for s in split:
        have: set[str] = set()
        for line in s:
            seen.append(float(len(line) > 20 and line in have))
            have.add(line)
    x[:, 11] = seen
    counts = np.array([len(s) for s in split])
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    ends = np.cumsum(counts)
    before[np.concatenate([[0], ends[:-1]])] = 0
    after[ends - 1] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], 1), size, counts


def chain(score: np.ndarray, move: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over many chains at once: (P(good) per line, expected label pairs, log of all partition sums).

    score: of a line being good, against 0 for bad; move: score of (label before, label); counts: lines of each chain, one after the other.
    """
    n, longest = len(counts), int(counts.max(initial=0))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(int)
    order = np.argsort(-counts, kind="stable")
    start, size = first[order], counts[order]
    emit = np.exp(np.stack([np.minimum(0, -score), np.minimum(0, score)], 1))  # of bad and good, the larger one 1
    m = np.exp(move)
    forward, backward, scale = np.zeros((len(score), 2)), np.ones((len(score), 2)), np.ones(len(score))
    for t in range(longest):
        live = int(np.searchsorted(-size, -t, "left"))
        at = start[:live] + t
        f = emit[at] * (0.5 if t == 0 else forward[at - 1] @ m)
        scale[at] = f.sum(1)
        forward[at] = f / scale[at][:, None]
    for t in range(longest - 2, -1, -1):
        live = int(np.searchsorted(-size, -(t + 1), "left"))
        at = start[:live] + t
        backward[at] = (emit[at + 1] * backward[at + 1] / scale[at + 1][:, None]) @ m.T
    good = forward[:, 1] * backward[:, 1]
    inner = np.ones(len(score), bool)
    inner[first[counts > 0]] = False
    b = np.flatnonzero(inner)
    pairs = forward[b - 1][:, :, None] * m[None] * (emit[b] * backward[b] / scale[b][:, None])[:, None, :]
    return good, pairs.sum(0), float(np.log(scale).sum() + np.maximum(0, score).sum() + n * 0)


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and moves of the largest conditional likelihood, by Adam steps.  y: label of each line."""
    w, move = np.zeros(x.shape[1]), np.zeros((2, 2))
    inner = np.ones(len(y), bool)
    inner[np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(int)] = False
    b = np.flatnonzero(inner)
    true = np.zeros((2, 2))
    np.add.at(true, (y[b - 1], y[b]), 1.0)
    m1, m2 = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for t in range(1, STEPS + 1):
        good, pairs, _ = chain(x @ w, move, counts)
        g = np.concatenate([x.T @ (y - good), (true - pairs).ravel()]) / len(y) - RIDGE * np.concatenate([w, move.ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = RATE * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, move = w + step[:-4], move + step[-4:].reshape(2, 2)
    return w, move


def train_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    x, _, counts = line_features(pdf.sort_values(["doc_id", "text"])["text"].fillna("").tolist())
    y = np.repeat(pdf.sort_values(["doc_id", "text"])["quality"].to_numpy(int), counts)
    w, move = fit(x, counts, y)
    return pd.DataFrame({"at": np.arange(len(w) + 4), "weight": np.concatenate([w, move.ravel()])})


@dataclass
class Model:
    weights: np.ndarray
    move: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """Log-odds of the length-weighted share of good text."""
        texts, out = [t or "" for t in texts], []
        for a, b in blocks(texts, BLOCK_CHARS):
            x, size, counts = line_features(texts[a:b])
            good, _, _ = chain(x @ self.weights, self.move, counts)
            doc = np.repeat(np.arange(b - a), counts)
            p = np.bincount(doc, good * (size + 1), b - a) / np.bincount(doc, size + 1, b - a)
            p = np.clip(p, 1e-4, 1 - 1e-4)
            out.append(np.log(p / (1 - p)))
        return np.concatenate(out) if out else np.zeros(0)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.shares(texts) + self.offset)))


def curve(v: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic curve, by Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * v + b, -30, 30)))
        g = np.array([(weight * (y - p) * v).sum() - 0.1 * (a - 1), (weight * (y - p)).sum() - 0.1 * b])
        q = weight * p * (1 - p)
        h = np.array([[(q * v * v).sum() + 0.1, (q * v).sum()], [(q * v).sum(), q.sum() + 0.1]])
        d = np.linalg.solve(h, g)
        a, b = a + np.clip(d[0], -1, 1), b + np.clip(d[1], -1, 1)
    return max(a, 0.0), b


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled documents whose crc32(doc_id) mod 4 is not 2.  Of a document with several labels the smallest counts."""
    known = labels.filter((id_bucket("doc_id", 4) != 2) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}  # two rows at most
    if len(sizes) < 2:
        # Nothing to tell apart: every document gets the label's share.
        return Model(np.zeros(SIZE), np.zeros((2, 2)), 0.0, math.log((sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + 0.5)))
    every = {q: max(1, round(n / PER_LABEL)) for q, n in sizes.items()}
    rate = F.when(F.col("quality") == 1, every[1]).otherwise(every[0])
    some = known.withColumn("order", F.xxhash64("doc_id")).filter(F.pmod("order", rate) == 0)
    # At most about 2 x PER_LABEL ids: bounded whatever the corpus, so they go to the documents.
    shards = min(SHARDS, max(1, sum(n // every[q] for q, n in sizes.items()) // SHARD))
    # A fifth lies aside for the curve.
    shard = F.when(F.pmod(F.hash("order"), F.lit(5)) > 0, F.pmod(F.hash(F.hash("order")), F.lit(shards))).otherwise(-1)
    sample = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").withColumn("shard", shard)
    parts = sample.filter(F.col("shard") >= 0).groupBy("shard").applyInPandas(train_shard, "at long, weight double")
    rows = parts.groupBy("at").agg(F.avg("weight").alias("weight")).toPandas().set_index("at")["weight"]
    w = np.array([rows.get(i, 0.0) for i in range(SIZE + 4)])
    model = Model(w[:-4], w[-4:].reshape(2, 2))

    def shares(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(model.shares(batch.column("text").to_pylist()))], ["quality", "share"])

    rest = sample.filter(F.col("shard") < 0).select("quality", "text").mapInArrow(shares, "quality int, share double").toPandas()  # of the bounded sample
    if len(rest):
        y = rest["quality"].to_numpy(float)
        model.slope, model.offset = curve(rest["share"].to_numpy(), y, np.where(y == 1, every[1], every[0]).astype(float))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (higher: label 1 likelier), predicted (1 if score >= 0.7).

    Null texts count as empty; an empty text is one empty line.  Null ids are not held out.  Repeated rows come out repeated, an empty table gives
    no rows, other columns are ignored.  Without labels of both kinds every text has the same score.
    """
    def run(batches):
        for batch in batches:
            s = model.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= LEAST).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (id_bucket("doc_id", 4) == 2).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """The documents, all their columns, of at least this score."""
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.score(batch.column("text").to_pylist()) >= least))

    return docs.mapInArrow(run, docs.schema)
