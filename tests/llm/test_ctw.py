import math
from collections import Counter
from functools import cache

import pytest
from oddities import ROWS

from weblode.llm import ctw
from weblode.llm.common import bucket_of

TEXTS = [(i, t) for i, t in enumerate(["The cat sat.", "the cat sat on the mat", "THE dog\tran\n", "", None, "é à é à", "aaaaaaaaaa", "the cat sat"] * 4)]


def brute(rows, depth):
    """Scores by plain recursion over the tree."""
    train = [ctw.lower_bytes(t) for i, t in rows if bucket_of(i, 7) != 2]
    counts = Counter()
    pad = b"\xff" * depth
    for t in train:
        s = pad + t + b"\xff"
        for p in range(depth, len(s)):
            for d in range(depth + 1):
                for j in range(8):
                    counts[s[p - d : p], (1 << j) | (s[p] >> (8 - j)), s[p] >> (7 - j) & 1] += 1
    children = {}
    for ctx, node, _ in counts:
        if ctx:
            children.setdefault((ctx[1:], node), set()).add(ctx)

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @cache
    def pw(ctx, node):
        own = kt(counts[ctx, node, 0], counts[ctx, node, 1])
        if len(ctx) == depth:
            return own
        below = sum(pw(c, node) for c in children.get((ctx, node), ()))
        return max(own, below) + math.log(math.exp(own - max(own, below)) + math.exp(below - max(own, below))) - math.log(2)

    def p(history, node, bit, d=0):
        ctx = history[len(history) - d :]
        n = counts[ctx, node, 0] + counts[ctx, node, 1]
        q = (counts[ctx, node, bit] + 0.5) / (n + 1)
        if d == depth:
            return q
        w = math.exp(kt(counts[ctx, node, 0], counts[ctx, node, 1]) - math.log(2) - pw(ctx, node))
        return w * q + (1 - w) * p(history, node, bit, d + 1)

    words = Counter(w for t in train for w in [*t.split(), ctw.END])
    n, v = sum(words.values()), len(words)
    out = {}
    for i, t in rows:
        t = ctw.lower_bytes(t)
        s, score = pad + t + b"\xff", 0.0
        for k in range(depth, len(s)):
            score += sum(math.log10(p(s[k - depth : k], (1 << j) | (s[k] >> (8 - j)), s[k] >> (7 - j) & 1)) for j in range(8))
        tokens = [*t.split(), ctw.END]
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens)
        out[i] = (len(tokens), sum(words[w] > 0 for w in tokens), n, base, score)
    return out


def test_against_recursion(documents):
    want = brute(TEXTS, ctw.DEPTH)
    for r in ctw.scores(documents(*TEXTS), chunk_bytes=100).collect():
        n, known, all_, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, all_)
        assert r.held_out == (bucket_of(r.doc_id, 7) == 2)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, rel=1e-5)


def test_chance_sums_to_one(documents):
    """Over all bytes the blended probabilities of one context are a distribution."""
    import numpy as np

    keys = np.arange(256, dtype=np.uint64) | np.uint64(0x4142434445 << 8)
    n = np.zeros(256)
    n[65], n[66] = 5, 2
    _, node, p, _, _ = ctw.subtree(keys, n)
    assert p.prod(1).sum() == pytest.approx(1.0)


def test_odd_rows(documents):
    got = ctw.scores(documents(*ROWS)).collect()
    assert len(got) == len(ROWS)
    assert all(r.score < 0 and r.base_score < 0 and math.isfinite(r.score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}


def test_empty_table(documents):
    assert ctw.scores(documents((1, "x")).filter("false")).count() == 0
