"""What a task does for each word and byte of a chunk."""

import cProfile
import pstats
from collections import Counter

import numpy as np
import pyarrow as pa

from weblode.llm import ctw

ODD = [None, "", " \t\n\x0b\x0c\r", "\x1cA\x85b C Ünï É\x00 x a a", "Z" * 300, "the cat  sat on the mat"]


def chunk(texts, held_out):
    return pa.table({"doc_id": pa.array(range(len(texts))), "text": texts, "held_out": held_out})


def test_no_call_for_each_word():
    texts = [" ".join(f"w{i}x{j}" for j in range(1000)) for i in range(20)]
    rows = chunk(texts, [i % 7 == 2 for i in range(20)])
    with cProfile.Profile() as p:
        out = ctw.count_chunk((pa.scalar(0),), rows)
        found = pa.table({"word": out["word"], "key": out["key"], "value": out["n"].cast("double")})
        got = ctw.score_chunk(10, -3.0, -1.0)((pa.scalar(0),), rows, found)
    # 20,000 distinct words, of which 3,000 are in no training text; each was a call or more when it was counted and another four when scored.
    assert pstats.Stats(p).total_calls < 10_000
    assert got["n_known"].to_pylist() == [1 if i % 7 == 2 else 1001 for i in range(20)]


def test_keys_and_counts_of_odd_texts():
    texts = [ctw.lower_bytes(t) for t in ODD]
    key, doc = ctw.context_keys(texts)
    want, words = [], Counter()
    for i, t in enumerate(texts):
        s = b"\xff" * ctw.DEPTH + t + b"\xff"
        want += [(int.from_bytes(s[p - ctw.DEPTH : p][::-1] + s[p : p + 1], "big"), i) for p in range(ctw.DEPTH, len(s))]
    assert list(zip(key.tolist(), doc.tolist(), strict=True)) == want
    held_out = [False, False, True, False, True, True]
    out = ctw.count_chunk((pa.scalar(3),), chunk(ODD, held_out)).to_pylist()
    for t, h in zip(texts, held_out, strict=True):
        for w in t.split():
            words[ctw.word_key(w)] += not h
    words[ctw.WORD] = 3
    assert {r["key"]: r["n"] for r in out if r["word"]} == words
    contexts = Counter()
    for k, i in want:
        contexts[k] += not held_out[i]
    assert {r["key"]: r["n"] for r in out if not r["word"]} == contexts
    assert len(out) == len(words) + len(contexts)


def test_values_of_keys_in_any_order():
    keys, values = np.array([-5, 0, 7]), np.array([1.0, 2.0, 3.0])
    assert ctw.values_of(np.array([7, 8, -5, -6, 7, 0, 1]), keys, values, -9.0).tolist() == [3, -9, 1, -9, 3, 2, -9]
    assert ctw.values_of(np.array([4, 4]), keys[:0], values[:0], -9.0).tolist() == [-9, -9]
    assert ctw.values_of(np.zeros(0, np.int64), keys, values, -9.0).tolist() == []
