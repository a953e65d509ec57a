"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters counts as a blank, and n-grams of one to three characters fall into ``FEATURES`` hashed features with
sublinear counts, inverse document frequencies of the whole training corpus, and unit length.  Weights are learned by
follow-the-regularised-leader (FTRL-proximal) with an elastic net, on ``SHARDS`` shards of a sample of at most about ``PER_LANGUAGE``
texts a language, and averaged.  A part of the sample that no shard saw fixes the temperature that calibrates the probabilities.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weblode.llm.common import blocks, id_bucket

FEATURES = 1 << 15
SIZES = (1, 2, 3)
#: Texts of a language that are learned from (expected; the bound of the sample).
PER_LANGUAGE = 1500
SHARDS = 8
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
BLOCK_CHARS = 1 << 20
NONE = "und"

LETTER = re.compile(r"[^\W\d_]")
TABLE: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Of the basic plane, the code point itself for letters, else a blank."""
    if not TABLE:
        TABLE.append(np.array([i if not 0xD800 <= i < 0xE000 and chr(i).isalpha() else 32 for i in range(1 << 16)], np.uint32))
    return TABLE[0]


def feature_counts(texts: list[str]):
    """(features, counts) of every text."""
    pad = "  "
    joined = np.frombuffer((pad.join(t.lower() for t in texts) + pad).encode("utf-32-le", "surrogatepass"), np.uint32)
    # Characters beyond the basic plane stand for themselves.
    cp = np.where(joined < 1 << 16, letters()[np.minimum(joined, 0xFFFF)], joined)
    ends = np.cumsum([len(t.lower()) + len(pad) for t in texts])
    word = cp != 32
    hashed, keep, h = [], [], np.zeros(len(cp), np.uint32)
    with np.errstate(over="ignore"):
        for n in SIZES:
            shifted = np.concatenate([cp[n - 1 :], np.full(n - 1, 32, np.uint32)])
            h = (h ^ shifted) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            hashed.append(((h * np.uint32(0x85EBCA77) + np.uint32(n)) * np.uint32(0xC2B2AE3D)) >> np.uint32(17))
            # An n-gram has a letter at its first or second place.
            keep.append(word if n == 1 else word | np.concatenate([word[1:], [False]]))
    start = 0
    for stop in ends.tolist():
        ids = np.concatenate([x[start : stop - len(pad)][k[start : stop - len(pad)]] for x, k in zip(hashed, keep, strict=True)])
        n = np.bincount(ids, minlength=FEATURES)
        f = np.flatnonzero(n)
        yield f, n[f]
        start = stop


def vector(f: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1.0 + np.log(n)) * idf[f]
    size = math.sqrt(float(x @ x))
    return x / size if size else x


def document_frequencies(batches):
    total, df = 0, np.zeros(FEATURES, np.int64)
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for a, b in blocks(texts, BLOCK_CHARS):
            for f, _ in feature_counts(texts[a:b]):
                df[f] += 1
                total += 1
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, FEATURES)), pa.array(np.append(df[some], total))], ["feature", "n"])


class Ftrl:
    """FTRL-proximal for softmax regression; feature FEATURES is the constant."""

    def __init__(self, classes: int):
        self.z, self.n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def weights(self, f: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[f], self.n[f]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, f: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(f)
        p = softmax(x @ w)
        p[y] -= 1.0
        g = x[:, None] * p[None]
        n = self.n[f]
        self.z[f] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[f] = n + g * g


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def with_constant(f: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.append(f, FEATURES), np.append(x, 1.0)


def train_shard(idf: np.ndarray, langs: list[str]):
    number = {x: i for i, x in enumerate(langs)}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "text"])
        texts = pdf["text"].tolist()
        rows = [with_constant(f, vector(f, n, idf)) for a, b in blocks(texts, BLOCK_CHARS) for f, n in feature_counts(texts[a:b])]
        y = [number[x] for x in pdf["lang"]]
        model, luck = Ftrl(len(langs)), np.random.default_rng(5)
        for _ in range(EPOCHS):
            for i in luck.permutation(len(rows)):
                model.learn(*rows[i], y[i])
        w = model.weights(slice(None))
        f, c = np.nonzero(w)
        return pd.DataFrame({"feature": f.astype(np.int64), "lang": c.astype(np.int64), "weight": w[f, c]})

    return run


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str | None]) -> np.ndarray:
        texts = [t or "" for t in texts]
        out = np.zeros((len(texts), max(1, len(self.langs))))
        i = 0
        for a, b in blocks(texts, BLOCK_CHARS):
            for f, n in feature_counts(texts[a:b]):
                if len(self.langs):
                    out[i] = vector(f, n, self.idf) @ self.weights[f] + self.weights[FEATURES]
                i += 1
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return [NONE] * len(texts), [0.0] * len(texts)
        p = softmax(self.logits(texts) / self.temperature)
        best = p.argmax(1)
        lettered = [bool(t and LETTER.search(t)) for t in texts]
        return [self.langs[k] if ok else NONE for k, ok in zip(best, lettered, strict=True)], [float(v) if ok else 0.0 for v, ok in zip(p.max(1), lettered, strict=True)]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    loss = lambda t: -np.log(np.maximum(softmax(logits / math.exp(t))[np.arange(len(y)), y], 1e-300)).mean()
    a, b, r = -4.0, 3.0, (math.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return math.exp((a + b) / 2)


def sampled(known: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """About ``PER_LANGUAGE`` rows of (doc_id, text, lang) a language, by hash, with their order and shard.

    Copies of a text under other ids are drawn and dealt each for itself; repeated rows of one id and text are one row, null texts none.
    """
    every = F.create_map(*[F.lit(x) for lang in sorted(sizes) for x in (lang, max(1, round(sizes[lang] / PER_LANGUAGE)))])
    rows = known.filter("text is not null").withColumn("order", F.xxhash64("doc_id", "text"))
    rows = rows.filter(F.pmod(F.col("order"), every[F.col("lang")]) == 0).dropDuplicates(["order", "lang"])
    return rows.withColumn("shard", F.pmod(F.hash("order"), F.lit(SHARDS + 2)))


def trained(docs: DataFrame) -> Model:
    """Learn from the texts with a language whose crc32(doc_id) mod 4 is not 2."""
    known = docs.filter((id_bucket("doc_id", 4) != 2) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros(FEATURES), np.zeros((FEATURES + 1, 1)))
    rows = known.select("text").mapInArrow(document_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()  # FEATURES + 1 rows
    at = rows.set_index("feature")["n"]
    df = np.zeros(FEATURES)
    df[at.index[at.index < FEATURES]] = at[at.index < FEATURES]
    idf = np.log((1.0 + at[FEATURES]) / (1.0 + df)) + 1.0
    sample = sampled(known, sizes)
    learned = sample.filter(F.col("shard") < SHARDS).groupBy("shard").applyInPandas(train_shard(idf, langs), "feature long, lang long, weight double")
    total = learned.groupBy("feature", "lang").agg(F.sum("weight").alias("weight")).toPandas()  # FEATURES x languages
    weights = np.zeros((FEATURES + 1, len(langs)))
    weights[total["feature"], total["lang"]] = total["weight"] / SHARDS
    model = Model(langs, idf, weights)

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(list(model.logits(batch.column("text").to_pylist())), pa.list_(pa.float64()))], ["lang", "logits"])

    rest = sample.filter(F.col("shard") >= SHARDS).select("text", "lang").mapInArrow(held, "lang string, logits array<double>").toPandas()  # of the bounded sample
    if len(rest):
        number = {x: i for i, x in enumerate(langs)}
        model.temperature = temperature(np.stack(rest["logits"].tolist()), rest["lang"].map(number).to_numpy())
    return model


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score.

    ``und`` with score 0 for null texts and texts without a letter; also for all texts where nothing could be learned.  Null ids are not held out.
    Repeated rows come out repeated; an empty table gives no rows; other columns are ignored.
    """
    def run(batches):
        for batch in batches:
            lang, score = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", (id_bucket("doc_id", 4) == 2).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def kept(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents, all their columns, whose language is known with at least this probability."""
    def run(batches):
        for batch in batches:
            lang, score = model.predict(batch.column("text").to_pylist())
            yield batch.filter(pa.array([x != NONE and s >= least for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
