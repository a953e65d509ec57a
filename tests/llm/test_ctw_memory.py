"""What a task holds while it counts the contexts of a chunk."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from weblode.llm import ctw


def test_parts_are_summed_a_range_of_keys_at_a_time():
    rng = np.random.default_rng(5)
    parts = []
    for n in (3_000_000, 900_000, 7, 0):
        key, count = np.unique(rng.integers(0, 4_000_000, n).astype(np.uint64), return_counts=True)
        parts.append((key, count))
    want = Counter()
    for key, count in parts[1:]:
        want.update(dict(zip(key.tolist(), count.tolist(), strict=True)))
    held = sum(k.nbytes + n.nbytes for k, n in parts)
    tracemalloc.start()
    key, n = ctw.summed(parts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The result twice while its pieces are joined, and copies of one range; a sort of all rows took 2.5 times what the parts hold.
    assert peak < 2 * (key.nbytes + n.nbytes) + 0.5 * held
    assert (np.diff(key.astype(np.int64)) > 0).all() and n.sum() == sum(c.sum() for _, c in parts)
    small, counts = ctw.summed(parts[1:])
    assert dict(zip(small.tolist(), counts.tolist(), strict=True)) == want


def test_counts_of_a_chunk_leave_in_pieces(monkeypatch):
    monkeypatch.setattr(ctw, "SENT", 30)
    texts = ["The quick brown fox " * 9, None, "", "jumps over a lazy dog; the dog sleeps on"]
    chunk = pa.table({"doc_id": [1, 2, 3, 4], "text": texts, "held_out": [False, False, True, True]})
    out = ctw.count_chunk((pa.scalar(7),), chunk)
    assert max(b.num_rows for b in out.to_batches()) <= 30 < out.num_rows
    words = Counter({w: 9 for w in ("the", "quick", "brown", "fox")}) + Counter()
    got = {r["key"]: r["n"] for r in out.filter(out["word"]).to_pylist()}
    assert all(got[ctw.word_key(w.encode())] == c for w, c in words.items()) and got[ctw.word_key(b"jumps")] == 0 and got[ctw.WORD] == 2
    # Contexts: every byte and end of the two training texts.
    assert sum(r["n"] for r in out.filter(pa.compute.invert(out["word"])).to_pylist()) == len(texts[0]) + 1 + 1
