"""Benchmark decontamination: chained word pairs as seeds, then Smith-Waterman alignment.

1. A pair is two words of an item that follow each other or have one word between them.  An alignment that reaches ``LEAST`` has at least
   ``LEAST`` * words - 1 pairs of equal words with at most one edit between them: it has M equal words and E edits, 2 M - E >= 2 LEAST n, and each
   gap without such a pair costs two edits, so M - 1 - E / 2 are left.  An item may therefore do without the half of so many places whose
   words are the most common in the corpus, and the other half must still be hit.  What is found does not depend on the size of the corpus.
2. Documents are scanned for the pairs, again with at most one word between; where as many different places of an item as that are hit
   within the length an alignment can have, the hits say where the item would lie.
3. The item is aligned with that stretch and all that an alignment can add on either side: +2 for an equal word, -1 for a different, missing
   or added one.  A document is contaminated where the best local score reaches ``LEAST`` of the item's full score.

An item of one or two words has itself as its seed: one word of two is no copy.
Items are taken in blocks of at most ``ITEMS`` items and ``ITEM_BYTES`` bytes, so what a task holds of them is bounded, and every block meets all documents.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weblode.llm.common import blocks, mix64

LEAST = 0.4
ITEMS, ITEM_BYTES = 20_000, 8 << 20
BLOCK_CHARS = 1 << 20
#: Hits that are worked out at a time; those of one document stay together.
HITS = 1 << 21
MATCH, OTHER = 2, -1
WORD = re.compile(r"\w+")

OUT = "doc_id long, item_id long, score double, aligned_words long, item_words long, first_word long, last_word long"


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Items:
    """A block of test items as word numbers."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.number: dict[str, int] = {}
        self.ids, self.items = [], []
        for item_id, text in rows:
            w = words(text)
            if w:
                self.ids.append(item_id)
                self.items.append(np.array([self.number.setdefault(x, len(self.number)) for x in w], np.int64))

    def seed(self, counts: np.ndarray) -> None:
        """Choose the seeds.  How often each word stands in the corpus only ranks the places of an item."""
        size = np.array([len(x) for x in self.items], np.int64)
        self.need = np.ones(len(size), np.int64)
        #: Most words of a document that an alignment covers, and most that it adds to the item's own.
        self.reach, self.slack = np.ceil((3 - 2 * LEAST) * size).astype(np.int64), np.ceil(2 * (1 - LEAST) * size).astype(np.int64)
        keys, items, places = [], [], []
        for at, item in enumerate(self.items):
            n = len(item)
            if n == 1:
                found = [(np.zeros(1, np.int64), self.alone + item)]
            else:
                c = np.append(counts[item].astype(float), 0.0)
                common = c[: n - 1] * np.maximum(c[1:n], c[2:])
                least = max(1, math.ceil(LEAST * n - 1 - 1e-9))
                self.need[at] = (least + 1) // 2
                place = np.sort(np.argsort(common, kind="stable")[: n - 1 - (least - self.need[at])])
                wide = place[place < n - 2]
                found = [(place, self.pair(item[place], item[place + 1])), (wide, self.pair(item[wide], item[wide + 2]))]
            for place, key in found:
                keys.append(key)
                places.append(place)
                items.append(np.full(len(place), at, np.int64))
        key, item, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, items, places))
        order = np.argsort(key, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, first = np.unique(key[order], return_index=True)
        self.first = np.append(first, len(key))
        self.shift = np.uint64(64 - min(26, max(20, 4 + len(self.keys).bit_length())))
        self.sieve = np.zeros(1 << (64 - int(self.shift)), bool)
        self.sieve[self.sieved(self.keys)] = True

    @property
    def alone(self) -> int:
        """What keys of single words begin at."""
        return len(self.number) ** 2

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * len(self.number) + b

    def sieved(self, key: np.ndarray) -> np.ndarray:
        return (mix64(key.astype(np.uint64) + np.uint64(1)) >> self.shift).astype(np.int64)

    def joined(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of some texts with a -1 after each, and where each text begins."""
        flat: list[int] = []
        starts, get = [], self.number.get
        for t in texts:
            starts.append(len(flat))
            flat += [get(w, -1) for w in words(t)]
            flat.append(-1)
        return np.array(flat, np.int64), np.array(starts, np.int64)

    def seeds(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, key's number) of every seed in a sequence of word numbers; none reaches over the end of a text."""
        end = np.zeros(len(ids), bool)
        end[starts[1:] - 1] = True
        known = ids >= 0
        found = []
        for step in (1, 2):
            some = known[:-step] & known[step:]
            if step == 2:
                some &= ~end[1:-1]
            start = np.flatnonzero(some)
            found.append((start, self.pair(ids[start], ids[start + step])))
        if len(self.keys) and self.keys[-1] >= self.alone:
            start = np.flatnonzero(known)
            found.append((start, self.alone + ids[start]))
        where, number = [], []
        for start, key in found:
            some = self.sieve[self.sieved(key)]
            start, key = start[some], key[some]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            same = self.keys[at] == key
            where.append(start[same])
            number.append(at[same])
        where, number = np.concatenate(where), np.concatenate(number)
        order = np.argsort(where, kind="stable")
        return where[order], number[order]

    def chains(self, ids: np.ndarray, starts: np.ndarray):
        """(text, item, [(position in the text, position in the item), ...]) where an item has hits enough, close enough together."""
        where, number = self.seeds(ids, starts)
        doc = np.searchsorted(starts, where, "right") - 1
        many = self.first[number + 1] - self.first[number]
        total = np.concatenate([[0], np.cumsum(many)])
        begins = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
        begins = np.append(begins, len(doc))
        at = 0
        while at < len(begins) - 1:
            to = max(at + 1, int(np.searchsorted(total[begins], total[begins[at]] + HITS, "right")) - 1)
            part = slice(begins[at], begins[to])
            yield from self.chained(where[part], doc[part], number[part], many[part], starts)
            at = to

    def chained(self, where: np.ndarray, doc: np.ndarray, number: np.ndarray, many: np.ndarray, starts: np.ndarray):
        one = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[number], many)
        doc, item, p, q = np.repeat(doc, many), self.item[one], np.repeat(where, many), self.place[one]
        p = p - starts[doc]
        order = np.lexsort((q, p, item, doc))
        doc, item, p, q = doc[order], item[order], p[order], q[order]
        other = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
        new = other.copy()
        new[1:] |= (p[1:] != p[:-1]) | (q[1:] != q[:-1])
        doc, item, p, q, group = doc[new], item[new], p[new], q[new], (np.cumsum(other) - 1)[new]
        last = np.arange(len(p)) + self.need[item] - 1
        held = np.minimum(last, len(p) - 1)
        enough = (last < len(p)) & (group[held] == group) & (p[held] - p < self.reach[item])
        bound = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        for g in np.unique(group[enough]).tolist():
            a, b = bound[g], bound[g + 1]
            hits = close(list(zip(p[a:b].tolist(), q[a:b].tolist(), strict=True)), int(self.need[item[a]]), int(self.reach[item[a]]))
            if hits:
                yield int(doc[a]), int(item[a]), hits


def close(hits: list[tuple[int, int]], need: int, reach: int) -> list[tuple[int, int]]:
    """The hits that lie in some stretch of ``reach`` words with ``need`` different places of the item."""
    inside: dict[int, int] = defaultdict(int)
    out, a, done = [], 0, 0
    for b, (p, q) in enumerate(hits):
        inside[q] += 1
        while p - hits[a][0] >= reach:
            inside[hits[a][1]] -= 1
            if not inside[hits[a][1]]:
                del inside[hits[a][1]]
            a += 1
        if len(inside) >= need:
            out += hits[max(a, done) : b + 1]
            done = b + 1
    return out


def align(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment: (score, equal words, first, last + 1 word of the stretch)."""
    m = len(stretch)
    step = np.arange(m + 1)
    h, rows = np.zeros(m + 1, np.int64), []
    for w in item:
        diagonal = h[:-1] + np.where(stretch == w, MATCH, OTHER)
        new = np.zeros(m + 1, np.int64)
        new[1:] = np.maximum(0, np.maximum(diagonal, h[1:] + OTHER))
        # A gap along the row costs one a word: the running maximum of h[j] + j, less j.
        h = np.maximum.accumulate(new - OTHER * step) + OTHER * step
        rows.append(h)
    table = np.stack([np.zeros(m + 1, np.int64), *rows])
    i, j = divmod(int(table.argmax()), m + 1)
    score, last, equal = int(table[i, j]), j, 0
    while i and j and table[i, j]:
        hit = stretch[j - 1] == item[i - 1]
        if table[i, j] == table[i - 1, j - 1] + (MATCH if hit else OTHER):
            i, j, equal = i - 1, j - 1, equal + bool(hit)
        elif table[i, j] == table[i - 1, j] + OTHER:
            i -= 1
        else:
            j -= 1
    return score, equal, j, last


def match(items: Items, ids: np.ndarray, item: int, hits: list[tuple[int, int]]) -> tuple[float, int, int, int] | None:
    """(score, equal words, first, last) of an item that a document contains, from the document's words and the chained hits."""
    n, slack = len(items.items[item]), int(items.slack[item])
    merged: list[list[int]] = []
    for a, b in sorted((max(0, p - q - slack), min(len(ids), p - q + n + slack)) for p, q in hits):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    best = max((*align(items.items[item], ids[a:b]), a) for a, b in merged)
    score = best[0] / (MATCH * n)
    return (score, best[1], best[2] + best[4], best[3] + best[4]) if score >= LEAST else None


def item_blocks(benchmark: DataFrame):
    """The items, a bounded block at a time."""
    items = benchmark.select("item_id", "text").filter("text is not null")
    n, size = items.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    parts = max(1, math.ceil(n / ITEMS * 1.5), math.ceil((size or 0) / ITEM_BYTES * 1.5)) if max(n / ITEMS, (size or 0) / ITEM_BYTES) > 1 else 1
    for part in range(parts if n else 0):
        block = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield Items([tuple(r) for r in block.collect()])


def word_counts(docs: DataFrame, items: Items) -> np.ndarray:
    """How often the corpus has each word of the items."""
    def count(batches):
        own = items
        n = np.zeros(len(own.number) + 1, np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in blocks(texts, BLOCK_CHARS):
                n += np.bincount(own.joined(texts[a:b])[0] + 1, minlength=len(n))
        some = np.flatnonzero(n[1:])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[1:][some])], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # words of one block of items
    counts = np.zeros(len(items.number), np.int64)
    for r in rows:
        counts[r.word] = r.n
    return counts


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, score (1 = the whole item word by word), aligned_words,
    item_words, and the stretch of the document's words.

    Null and empty texts and items without words match nothing.  Of an item that a document holds several times the best place counts; repeated rows
    come out repeated.  Empty tables give no rows.  Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    out = docs.sparkSession.createDataFrame([], OUT)
    for items in item_blocks(benchmark):
        if not items.ids:
            continue
        items.seed(word_counts(docs, items))
        out = out.unionByName(scanned(docs, items))
    return out


def scanned(docs: DataFrame, items: Items) -> DataFrame:
    def scan(batches):
        own = items
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            rows = []
            for a, b in blocks(texts, BLOCK_CHARS):
                flat, starts = own.joined(texts[a:b])
                for doc, item, hits in own.chains(flat, starts):
                    last_word = int(starts[doc + 1]) - 1 if doc + 1 < len(starts) else len(flat) - 1
                    if hit := match(own, flat[starts[doc] : last_word], item, hits):
                        rows.append((ids[a + doc], own.ids[item], *hit[:2], len(own.items[item]), *hit[2:]))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in OUT.split(", ")])

    return docs.mapInArrow(scan, OUT)
