"""Merkle fingerprints of documents.

The tree of a text: its paragraphs (lines) are hashed, runs of paragraphs form sections, sections the root.  A section ends after an empty
paragraph, or after one whose hash is divisible by ``SECTION``, so that an edit moves no boundary but its own.  Equal roots
mean equal texts; where roots differ, the differing sections and in them the differing paragraphs locate the edit.

Below the paragraphs are leaves of a few words, cut where the bytes before a white space say so.  A fingerprint is the root followed by a
sketch, the ``SKETCH`` smallest leaf values.

Likeness is taken from the trees while both texts are at hand: 1 for equal roots, else the share of bytes in equal sections, in equal paragraphs of
the others, and in equal leaves of what then still differs.  Of two fingerprints alone, without texts, ``alike`` estimates the share of common
leaves (twice the common ones by all of both), at most ``NEARLY``.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from weblode.llm.common import mix64, odd_numbers, written

SECTION = 8
SKETCH = 64
#: Unequal texts are never wholly alike.
NEARLY = 0.999
#: Bytes of leaves worked out at a time, and text bytes of a sorted part.
BLOCK, PART_BYTES = 1 << 20, 16 << 20

#: While they are compared, fingerprints and digests are bytes; the result has them in hexadecimal.
OUT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
ENDS = f"{OUT}, part_end string, text string"


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def branches(text: str) -> tuple[bytes, list[tuple[bytes, list[tuple[bytes, bytes]]]]]:
    """(root, [(section, [(paragraph, its bytes), ...]), ...])"""
    sections, now = [], []
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        p = digest(b"p" + line)
        now.append((p, line))
        if not line or p[0] % SECTION == 0:
            sections.append((digest(b"s" + b"".join(x for x, _ in now)), now))
            now = []
    if now:
        sections.append((digest(b"s" + b"".join(x for x, _ in now)), now))
    return hashlib.sha256(b"r" + b"".join(s for s, _ in sections)).digest(), sections


def tree(text: str) -> tuple[bytes, list[tuple[bytes, list[bytes]]]]:
    """(root, [(section, [paragraph, ...]), ...])"""
    root, sections = branches(text)
    return root, [(s, [p for p, _ in ps]) for s, ps in sections]


def changed(old: str, new: str) -> list[tuple[int, int]]:
    """Numbers (first, last + 1) of the paragraphs of ``new`` that lie in differing branches, found from the tops of both trees down."""
    a, b = tree(old), tree(new)
    if a[0] == b[0]:
        return []
    same = {s for s, _ in a[1]}
    leaves = {p for s, ps in a[1] if s not in {x for x, _ in b[1]} for p in ps}
    out, at = [], 0
    for s, ps in b[1]:
        if s not in same:
            for i, p in enumerate(ps, at):
                if p not in leaves:
                    if out and out[-1][1] == i:
                        out[-1] = (out[-1][0], i + 1)
                    else:
                        out.append((i, i + 1))
        at += len(ps)
    return out


R = int(odd_numbers(1, 23)[0])
POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and its inverse, modulo 2**64."""
    if not POWERS or len(POWERS[0]) < n:
        size = max(n, BLOCK + 1)
        with np.errstate(over="ignore"):
            POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (R, pow(R, -1, 1 << 64))]
    return POWERS[0], POWERS[1]


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def leaf_values(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, value, bytes) of every leaf of some texts."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    n = len(joined)
    up, down = powers(n)
    ends = np.cumsum([len(t) + 1 for t in texts])
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * up[:n])])
        before = np.zeros(n, np.uint64)
        begin = np.concatenate([[0], ends[:-1]])
        for i in (1, 2, 3):
            # What stands before a text says nothing of its leaves.
            byte = np.concatenate([np.full(min(i, n), 10, np.uint8), joined[:-i]])[:n]
            for k in range(i):
                byte[np.minimum(begin + k, n - 1)] = 10
            before = before * np.uint64(257) + byte
        cut = SPACE[joined] & (mix64(before) & np.uint64(1) == 0)
        cut[ends - 1] = True
        stop = np.flatnonzero(cut)
        start = np.concatenate([[0], stop[:-1] + 1])
        # White space around a leaf is no part of it, so a leaf is the same wherever it stands.
        some = stop > start
        start, stop = start[some], stop[some]
        value = mix64((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64) * np.uint64(R))
    return np.searchsorted(ends, start, "right"), value >> np.uint64(16), stop - start


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The smallest distinct leaf values of every text, at most SKETCH."""
    out: list[np.ndarray] = []
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    first = 0
    while first < len(raw):
        last, size = first, 0
        while last < len(raw) and (last == first or size + len(raw[last]) < BLOCK):
            size += len(raw[last]) + 1
            last += 1
        doc, value, _ = leaf_values(raw[first:last])
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])]) if len(doc) else np.zeros(0, bool)
        doc, value = doc[new], value[new]
        bound = np.searchsorted(doc, np.arange(last - first + 1))
        out += [value[a : min(b, a + SKETCH)] for a, b in zip(bound[:-1], bound[1:], strict=True)]
        first = last
    return out


def fingerprint(text: str, sketch: np.ndarray, root: bytes | None = None) -> bytes:
    """The root's 32 bytes and six for each value of the sketch."""
    return (root or tree(text)[0]) + sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def alike(a: bytes, b: bytes) -> float:
    """Likeness of two fingerprints."""
    if a == b:
        return 1.0
    x, y = ({s[i : i + 6] for i in range(32, len(s), 6)} for s in (a, b))
    if not x or not y:
        return 0.0
    # The smallest of both together are a sample of all leaves, each sketch says for itself whether it has them.
    sample = sorted(x | y)
    if len(x) >= SKETCH or len(y) >= SKETCH:
        sample = sample[:SKETCH]
    j = sum(v in x and v in y for v in sample) / len(sample)
    return min(NEARLY, 2 * j / (1 + j))


def differing(a: list, b: list) -> tuple[list, list, list]:
    """Of two lists of (digest, what it stands for): what both have, and the rest of either."""
    both = Counter(x for x, _ in a) & Counter(x for x, _ in b)
    common, rest = [], ([], [])
    for side, out in zip((a, b), rest, strict=True):
        left = both.copy()
        for x, what in side:
            if left[x] > 0:
                left[x] -= 1
                if side is a:
                    common.append(what)
            else:
                out.append((x, what))
    return common, *rest


def likenesses(pairs: list[tuple[tuple, tuple]]) -> list[float]:
    """Likeness of each two trees (``branches``), found from their tops down."""
    out, whole, lines = [1.0] * len(pairs), {}, []
    for k, (a, b) in enumerate(pairs):
        if a[0] != b[0]:
            sections, left, right = differing(a[1], b[1])
            paragraphs, left, right = differing([p for _, ps in left for p in ps], [p for _, ps in right for p in ps])
            whole[k] = sum(len(t) for ps in sections for _, t in ps) + sum(map(len, paragraphs))
            lines += [(k, 0, t) for _, t in left] + [(k, 1, t) for _, t in right]
    same, total = (np.zeros(len(pairs), np.int64) for _ in range(2))
    first = 0
    while first < len(lines):
        last, size = first, 0
        # A pair's lines stay together.
        while last < len(lines) and (size < BLOCK or lines[last][0] == lines[last - 1][0]):
            size += len(lines[last][2]) + 1
            last += 1
        text, value, length = leaf_values([t for _, _, t in lines[first:last]])
        pair, side = np.array([x[:2] for x in lines[first:last]], np.int64)[text].T
        total += np.bincount(pair, length, len(pairs)).astype(np.int64)
        order = np.lexsort((value, pair))
        pair, side, value, length = pair[order], side[order], value[order], length[order]
        begin = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (value[1:] != value[:-1])])) if len(pair) else np.zeros(0, np.int64)
        if len(begin):
            right = np.add.reduceat(side, begin)
            left = np.diff(np.append(begin, len(pair))) - right
            same += np.bincount(pair[begin], np.minimum(left, right) * length[begin], len(pairs)).astype(np.int64)
        first = last
    for k, n in whole.items():
        both = 2 * n + int(total[k])
        # Unequal texts are never wholly alike, also where only the order of their parts differs.
        out[k] = min(2 * (n + int(same[k])), both - 1) / both if both else 0.0
    return out


def compared(ids: list[int | None], texts: list[str]) -> dict[str, list]:
    """Rows of ``OUT`` for all texts but the last, each with the text after it."""
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:])]
    trees, new = [branches(t) for t in texts], [branches(t) for t in edited]
    prints = [fingerprint(t, s, x[0]) for t, s, x in zip(texts, sketches(texts), trees, strict=True)]
    edits = [fingerprint(t, s, x[0]) for t, s, x in zip(edited, sketches(edited), new, strict=True)]
    return {
        "doc_id": ids[: len(edited)], "n_chars": [len(t) for t in texts[:-1]],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in edited],
        "fingerprint": prints[:-1], "edited_fingerprint": edits,
        "near_edited": likenesses(list(zip(trees, new))), "near_next": likenesses(list(zip(trees, trees[1:]))),
    }


def batch_of(rows: dict[str, list], ends: list[str | None], texts: list[str | None]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()}
    kinds |= dict.fromkeys(("edited_sha256", "fingerprint", "edited_fingerprint"), pa.binary())
    names = [x.split()[0] for x in OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(rows[n], kinds.get(n, pa.string())) for n in names] + [pa.array(ends, pa.string()), pa.array(texts, pa.string())], [*names, "part_end", "text"])


def end_row(doc_id: int | None, text: str, kind: str) -> pa.RecordBatch:
    rows = {x.split()[0]: [None] for x in OUT.split(", ")} | {"doc_id": [doc_id]}
    return batch_of(rows, [kind], [text])


def along(batches):
    """Rows in order of doc_id, each compared with the next; the first and the last of the part also come out as they are."""
    ids: list[int | None] = []
    texts: list[str] = []
    begun, size = False, 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if not begun:
                begun = True
                yield end_row(i, t, "first")
            ids.append(i)
            texts.append(t)
            size += len(t)
            if len(texts) > 1 and size > BLOCK:
                rows = compared(ids, texts)
                yield batch_of(rows, [None] * len(rows["doc_id"]), [None] * len(rows["doc_id"]))
                ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
    if len(texts) > 1:
        rows = compared(ids, texts)
        yield batch_of(rows, [None] * len(rows["doc_id"]), [None] * len(rows["doc_id"]))
    if texts:
        yield end_row(ids[-1], texts[-1], "last")


def seam(batches):
    for batch in batches:
        for i, t, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text")), strict=True):
            rows = compared([i], [t, n])
            yield batch_of(rows, [None], [None]).select([x.split()[0] for x in OUT.split(", ")])


def fingerprints(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Fingerprint every text and its edited text: the last half replaced by as much of the next document's beginning.

    The next document is that of the next doc_id (after the last: the first); rows of one id follow in order of their texts, null ids come
    first.  A single row is its own next.  Null texts count as empty; an empty text is its own edited text, and has likeness 1 to it and
    to another empty one.  An empty table gives no rows.  Other columns are ignored.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / part_bytes))
    rows = written(docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(along, ENDS), "fingerprints")
    # Two rows a part.  Each part's last meets the next part's first.
    ends = rows.filter("part_end is not null").select("doc_id", "text", "part_end")
    order = Window.orderBy(F.col("doc_id").asc_nulls_first(), F.col("part_end") == "last", "text")
    after = F.coalesce(F.lead("text").over(order), F.first("text").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    seams = ends.withColumn("next_text", after).filter("part_end = 'last'").select("doc_id", "text", "next_text")
    out = rows.filter("part_end is null").drop("part_end", "text").unionByName(seams.mapInArrow(seam, OUT))
    low = lambda c: F.lower(F.hex(c))
    shown = lambda c: F.concat(low(F.substring(c, 1, 32)), F.lit(":"), low(F.substring(c, 33, 6 * SKETCH)))
    return out.select(
        "doc_id", "n_chars", low("edited_sha256").alias("edited_sha256"), shown("fingerprint").alias("fingerprint"),
        shown("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next",
    )
