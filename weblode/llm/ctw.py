"""Language-model scoring by context-tree weighting.

A byte is eight binary decisions; each decision has its own context tree over the bytes before it.  A node estimates by
Krichevsky and Trofimov from the zeros and ones seen in its context, and is mixed with its subtree: ``Pw = (KT + product of the
children's Pw) / 2``, down to ``DEPTH`` bytes.  The weight of a node in its mixture is ``KT / (2 Pw)``, so a byte's probability
is a blend of all depths.  Texts begin after ``DEPTH`` end marks (0xFF, no byte of UTF-8) and end with one.

How it runs: texts are dealt into chunks of about ``CHUNK_BYTES``.  A chunk gives its distinct contexts and words with their
training counts, contexts of texts that are only scored with a count of 0.  The counts are summed by key; the trees are
worked out per bucket of the last two context bytes, whose sums meet in a table of at most 256 x 255 rows for depths 1 and 0, the only
rows that reach the driver.  Each key's code length then goes back to the chunks that asked for it, and a chunk is scored
next to its own look-up table.  No task holds more than a chunk or one bucket of distinct contexts.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from weblode.llm.common import id_bucket, written

DEPTH = 5
CHUNK_BYTES = 24 << 20
#: Bytes that are sorted at a time, and the most texts among them.
BLOCK, TEXT_BITS = 1 << 20, min(14, 64 - 8 * (DEPTH + 1))
BLOCK_TEXTS = 1 << TEXT_BITS
END = 0xFF
#: Rows of an answer that leave a task at a time.
SENT = 1 << 16
#: The pairs of last context bytes are dealt into so many buckets.
BUCKETS = 512
WORD = -1

OUT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
)


def lower_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def context_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte and end of the texts its key, nearest context byte first and the byte itself last, and its text's number."""
    pad = bytes([END]) * DEPTH
    joined = b"".join(x for t in texts for x in (pad, t, pad[:1]))
    # Eight bytes read from DEPTH places before a byte hold its context, the nearest byte highest.
    key = np.ndarray(len(joined) - DEPTH, "<u8", joined + bytes(8), 0, (1,)) << np.uint64(8)
    key &= np.uint64((1 << 8 * (DEPTH + 1)) - 256)
    key |= np.frombuffer(joined, np.uint8)[DEPTH:]
    sizes = np.array([len(t) + 1 for t in texts])
    # The positions that are pads predict nothing.
    real = np.ones(len(key), bool)
    real[(np.cumsum(sizes + DEPTH)[:-1, None] - np.arange(1, DEPTH + 1)).ravel()] = False
    return key[real], np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def text_blocks(chunk: pa.Table):
    """(first, last + 1, lower-cased texts) of runs of about ``BLOCK`` bytes; only one run is taken out of the table at a time."""
    column = chunk.column("text")
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start, size = 0, 0
    for i, n in enumerate([*sizes, None]):
        if n is None or size and (size + n > BLOCK or i - start >= BLOCK_TEXTS):
            if i > start:
                yield start, i, [lower_bytes(t) for t in column.slice(start, i - start).to_pylist()]
            start, size = i, 0
        size += (n or 0) + 1


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Parts in order of their keys as one, counts of equal keys added.  A range of keys is merged at a time: besides the parts and the result, a task
    holds the working copies of about an eighth of a block."""
    rows = sum(len(key) for key, _ in parts)
    longest = max((key for key, _ in parts), key=len)
    cuts = longest[:: max(1, len(longest) * (BLOCK >> 3) // max(1, rows))][1:]
    edges = [np.concatenate([[0], np.searchsorted(key, cuts), [len(key)]]) for key, _ in parts]
    keys, counts = [], []
    for i in range(len(cuts) + 1):
        key = np.concatenate([k[e[i] : e[i + 1]] for (k, _), e in zip(parts, edges, strict=True)])
        n = np.concatenate([n[e[i] : e[i + 1]] for (_, n), e in zip(parts, edges, strict=True)])
        order = np.argsort(key)
        key, n = key[order], n[order]
        first = runs(key)
        keys.append(key[first])
        counts.append(np.add.reduceat(n, first) if len(first) else n)
    return np.concatenate(keys), np.concatenate(counts)


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words of the texts, one after another and before the shift of ``word_key``, and the number of words of each text."""
    lists = [t.split() for t in texts]
    sizes = np.array([len(w) for w in lists])
    return np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(lists)), np.uint64, sizes.sum()), sizes


def counted(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = runs(ordered)
    return ordered[first], np.diff(np.append(first, len(ordered)))


def count_chunk(key: tuple, chunk: pa.Table) -> pa.Table:
    """Distinct contexts and words of a chunk with their training counts."""
    train = ~np.array(chunk.column("held_out").to_pylist(), bool)
    parts, words = [], []
    for a, b, texts in text_blocks(chunk):
        k, doc = context_keys(texts)
        use = train[a:b][doc.astype(np.int64)]
        k = np.sort(k << np.uint64(1) | use.astype(np.uint64))
        u, n = counted(k)
        parts.append((u >> np.uint64(1), np.where(u & np.uint64(1), n, 0)))
        w, sizes = word_keys(texts)
        use = np.repeat(train[a:b], sizes)
        u, n = counted(np.sort(w[~use]))
        words += [counted(np.sort(w[use])), (u, np.zeros_like(n))]
        parts, words = [[summed(x)] if sum(len(k) for k, _ in x) > 3 * BLOCK else x for x in (parts, words)]
    rows = []
    for word, x, shift in ((False, parts, 0), (True, words, 1 << 63)):
        keys, n = summed(x) if x else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        x.clear()
        keys = (keys ^ np.uint64(shift)).view(np.int64)
        rows += [(word, keys[i : i + SENT], n[i : i + SENT]) for i in range(0, len(keys), SENT)]
    rows.append((True, np.array([WORD]), np.array([int(train.sum())])))
    # In pieces, so that neither side holds the whole answer as one batch besides.
    return pa.concat_tables(
        pa.table({"chunk": pa.array(np.full(len(k), key[0].as_py(), np.int64)), "word": pa.array(np.full(len(k), word)), "key": pa.array(k), "n": pa.array(c)})
        for word, k, c in rows
    )


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps of the recurrence; x at least 0.5."""
    shift = sum(np.log(x + i) for i in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones, in any order."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


def decisions(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight nodes of the bit tree (1 to 255) on a byte's way and the bits taken there; one row per byte."""
    j = np.arange(8)
    b = byte.astype(np.int64)[:, None]
    return (1 << j) | (b >> (8 - j)), b >> (7 - j) & 1


def level(node: np.ndarray, bit: np.ndarray, n: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of one depth.  node: per decision, any integers; below: log Pw summed over the children, by node, None for leaves.

    Returns the distinct nodes, the node number of every decision, log Pw, and the weight of the node itself.
    """
    names, at = np.unique(node, return_inverse=True)
    at = at.reshape(node.shape)
    ones = np.bincount(at.ravel(), (n[:, None] * bit).ravel(), len(names))
    all_ = np.bincount(at.ravel(), np.broadcast_to(n[:, None], bit.shape).ravel(), len(names))
    kt = log_kt(all_ - ones, ones)
    p = (np.where(bit == 1, ones[at], (all_ - ones)[at]) + 0.5) / (all_[at] + 1.0)
    if below is None:
        return names, at, kt, np.stack([np.ones(len(names)), all_, ones]), p
    pw = np.logaddexp(kt, below) - math.log(2)
    return names, at, pw, np.stack([np.exp(kt - math.log(2) - pw), all_, ones]), p


def subtree(keys: np.ndarray, n: np.ndarray):
    """Depths DEPTH to 2 for contexts that share all their last two bytes or not: probability of each decision, and the depth-2 nodes."""
    node, bit = decisions(keys & np.uint64(0xFF))
    p, pw, child = None, None, None
    for d in range(DEPTH, 1, -1):
        ctx = (keys >> np.uint64(8 * (DEPTH - d + 1))).astype(np.int64)
        name = ctx[:, None] * 256 + node
        if p is None:
            child, _, pw, _, p = level(name, bit, n, None)
            continue
        # A node's children have one more context byte, below the nearer ones.
        mine, back = np.unique((child >> 16 << 8) | (child & 0xFF), return_inverse=True)
        names, at, pw, (w, _, _), q = level(name, bit, n, np.bincount(back, pw, len(mine)))
        child, p = names, w[at] * q + (1 - w[at]) * p
    return bit, node, p, child, pw


def depth_two(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket: per last byte and bit node the log Pw of the depth-2 nodes together and the counts."""
    keys, n = pdf["key"].to_numpy().astype(np.uint64), pdf["n"].to_numpy().astype(float)
    bit, node, _, names, pw = subtree(keys, n)
    nearest = (keys >> np.uint64(8 * DEPTH)).astype(np.int64)
    name = (nearest[:, None] * 256 + node).ravel()
    out = np.unique(name)
    at = np.searchsorted(out, name)
    up = np.searchsorted(out, (names >> 16 << 8) | (names & 0xFF))
    w = np.broadcast_to(n[:, None], bit.shape).ravel()
    return pd.DataFrame({"node": out, "below": np.bincount(up, pw, len(out)), "n_all": np.bincount(at, w, len(out)), "ones": np.bincount(at, w * bit.ravel(), len(out))})


class Top:
    """Depths 1 and 0: at most 257 x 255 nodes, whatever the corpus."""

    def __init__(self, rows: pd.DataFrame):
        self.w = np.full((2, 65536), 0.5)
        self.all, self.ones = np.zeros((2, 65536)), np.zeros((2, 65536))
        at = rows["node"].to_numpy(np.int64)
        below = np.zeros(65536)
        self.all[1][at], self.ones[1][at], below[at] = rows["n_all"], rows["ones"], rows["below"]
        for d in (1, 0):
            kt = log_kt(self.all[d] - self.ones[d], self.ones[d])
            pw = np.logaddexp(kt, below) - math.log(2)
            self.w[d] = np.exp(kt - math.log(2) - pw)
            if d:
                for x, y in ((self.all, None), (self.ones, None), (None, pw)):
                    src = x[1] if x is not None else y
                    by_node = src.reshape(256, 256).sum(0)
                    if x is not None:
                        x[0][:256] = by_node
                    else:
                        below = np.zeros(65536)
                        below[:256] = by_node

    def blend(self, nearest: np.ndarray, node: np.ndarray, bit: np.ndarray, p: np.ndarray) -> np.ndarray:
        for d, at in ((1, nearest[:, None] * 256 + node), (0, node)):
            one = (self.ones[d][at] + 0.5) / (self.all[d][at] + 1.0)
            q = np.where(bit == 1, one, 1 - one)
            p = self.w[d][at] * q + (1 - self.w[d][at]) * p
        return p


def code_lengths(top: Top):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, n = pdf["key"].to_numpy().astype(np.uint64), pdf["n"].to_numpy().astype(float)
        bit, node, p, _, _ = subtree(keys, n)
        p = top.blend((keys >> np.uint64(8 * DEPTH)).astype(np.int64), node, bit, p)
        return pd.DataFrame({"key": pdf["key"], "value": np.log10(p).sum(1)})

    return run


def values_of(asked: np.ndarray, keys: np.ndarray, values: np.ndarray, floor: float) -> np.ndarray:
    """Values of the keys asked for, in any order, out of keys in order; the floor for those that are not among them."""
    names, back = np.unique(asked, return_inverse=True)
    at = np.searchsorted(keys, names)
    hit = at < len(keys)
    hit[hit] = keys[at[hit]] == names[hit]
    found = np.full(len(names), floor)
    found[hit] = values[at[hit]]
    return found[back]


def score_chunk(train_tokens: int, floor: float, end_value: float):
    def run(key: tuple, chunk: pa.Table, found: pa.Table) -> pa.Table:
        is_word = found.column("word").to_numpy().astype(bool)
        keys, values = found.column("key").to_numpy(), found.column("value").to_numpy()
        words, w_values = keys[is_word], np.log10(values[is_word] + 1) + floor
        order = np.argsort(words)
        words, w_values = words[order], w_values[order]
        keys, values = keys[~is_word].astype(np.uint64), values[~is_word]
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        rows = chunk.num_rows
        score, base, size = np.zeros(rows), np.zeros(rows), np.zeros(rows, np.int64)
        tokens, known = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        for a, b, texts in text_blocks(chunk):
            k, doc = context_keys(texts)
            k = np.sort(k << np.uint64(TEXT_BITS) | doc)  # equal keys come together, so each is looked up once
            doc = (k & np.uint64(BLOCK_TEXTS - 1)).astype(np.int64)
            k = k >> np.uint64(TEXT_BITS)
            first = runs(k)
            v = values[np.searchsorted(keys, k[first])]
            score[a:b] = np.bincount(doc, np.repeat(v, np.diff(np.append(first, len(k)))), b - a)
            w, n = word_keys(texts)
            w = values_of((w ^ np.uint64(1 << 63)).view(np.int64), words, w_values, floor)
            for i, t, v in zip(range(a, b), texts, np.split(w, np.cumsum(n)[:-1]), strict=True):
                tokens[i], known[i] = len(v) + 1, np.count_nonzero(v > floor) + (end_value > floor)
                base[i], size[i] = float(v.sum()) + end_value, len(t)
        return pa.table(
            {
                "doc_id": chunk.column("doc_id"), "held_out": chunk.column("held_out"),
                "n_tokens": pa.array(tokens), "n_known": pa.array(known),
                "train_tokens": pa.array(np.full(rows, train_tokens, np.int64)),
                "base_score": pa.array(base), "score": pa.array(score),
                "n_bytes": pa.array(size), "bits_per_byte": pa.array(-score / math.log10(2) / (size + 1)),
            }
        )

    return run


def scores(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Score every text; train on those whose crc32(doc_id) mod 7 is not 2.

    Null texts count as empty; an empty text is its end alone.  Null ids fall in the training part.  Repeated rows are trained on and
    scored each.  An empty table gives no rows.  Other columns are ignored.  ``bits_per_byte`` is the code length per byte, the end counted
    as one.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").withColumn("held_out", id_bucket("doc_id", 7) == 2)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(total / chunk_bytes))
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    asked = written(dealt.groupBy("chunk").applyInArrow(count_chunk, "chunk long, word boolean, key long, n long"), "contexts")
    known = written(asked.groupBy("word", "key").agg(F.sum("n").alias("n")), "counts")
    # One row: tokens and distinct tokens of the training texts, ends included.
    all_, distinct, ends = known.filter("word").agg(F.sum("n"), F.sum(F.when(F.col("n") > 0, 1)), F.max(F.when(F.col("key") == WORD, F.col("n")))).first()
    all_, distinct = all_ or 0, distinct or 0
    floor = -math.log10(all_ + distinct + 1)
    contexts = known.filter(~F.col("word")).select(F.pmod(F.hash(F.shiftright("key", 8 * (DEPTH - 1))), F.lit(BUCKETS)).alias("bucket"), "key", "n")
    # At most 256 x 255 rows, whatever the corpus.
    rows = contexts.groupBy("bucket").applyInPandas(depth_two, "node long, below double, n_all double, ones double")
    top = Top(rows.groupBy("node").agg(F.sum("below").alias("below"), F.sum("n_all").alias("n_all"), F.sum("ones").alias("ones")).toPandas())
    values = contexts.groupBy("bucket").applyInPandas(code_lengths(top), "key long, value double").select(F.lit(False).alias("word"), "key", "value")
    of_words = known.filter("word").select("word", "key", F.col("n").cast("double").alias("value"))
    found = asked.select("chunk", "word", "key").join(values.unionByName(of_words), ["word", "key"])
    return dealt.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(score_chunk(all_, floor, math.log10((ends or 0) + 1) + floor), OUT)
