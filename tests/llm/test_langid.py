import math
import random
from collections import Counter

import numpy as np
import pytest
from oddities import ROWS

from weblode.llm import langid
from weblode.llm.common import bucket_of

STEMS = {"en": ["the", "and", "th", "ing", "wh", "er"], "de": ["der", "und", "sch", "ung", "ein", "ü"], "fr": ["le", "de", "eau", "tion", "é", "ou"]}


def texts(n, seed=1):
    luck = random.Random(seed)
    out = []
    for i in range(n):
        lang = luck.choice(list(STEMS))
        out.append((i, " ".join("".join(luck.choice(STEMS[lang]) for _ in range(luck.randint(1, 3))) for _ in range(luck.randint(5, 60))), lang))
    return out


def test_held_out_accuracy(documents):
    rows = texts(300)
    df = documents(*rows)
    got = {r.doc_id: r for r in langid.predicted(df, langid.trained(df)).collect()}
    held = [i for i, _, _ in rows if bucket_of(i, 4) == 2]
    assert all(got[i].held_out == (bucket_of(i, 4) == 2) for i, _, _ in rows)
    assert sum(got[i].lang_pred == rows[i][2] for i in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(documents):
    df = documents(*texts(60), *[(1000 + (i or 500), t, None) for i, t in ROWS], (None, "the and", None), (None, None, "zz"))
    got = langid.predicted(df, langid.trained(df)).collect()
    assert len(got) == 60 + len(ROWS) + 2
    for r in got:
        if r.doc_id in (1001, 1002, 1003, 1012):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id and r.doc_id > 1000 and r.doc_id != 1500:
            assert r.lang_pred in (*STEMS, "zz")


def test_nothing_to_learn(documents):
    df = documents((1, "some text", None), (2, None, None))
    assert [(r.lang_pred, r.score) for r in langid.predicted(df, langid.trained(df)).collect()] == [("und", 0.0)] * 2
    empty = df.filter("false")
    assert langid.predicted(empty, langid.trained(empty)).count() == 0


def test_kept_keeps_columns(documents):
    df = documents(*texts(100), (2000, "123 456", "en"), (2001, None, "en"))
    got = langid.kept(df, langid.trained(df))
    assert got.columns == df.columns
    assert {r.doc_id for r in got.collect()} == set(range(100))


def test_features_are_those_of_each_text_alone():
    some = ["Ab c", "", "é\U0001f600x", "İi", "123"]
    together = list(langid.feature_counts(some))
    for t, (f, n) in zip(some, together, strict=True):
        (g, m), = langid.feature_counts([t])
        assert np.array_equal(f, g) and np.array_equal(n, m)
    f, n = together[0]
    grams = Counter(g for size in langid.SIZES for g in ("ab c  "[i : i + size] for i in range(4)) if g[0] != " " or size > 1 and g[1] != " ")
    assert sum(n) == sum(grams.values())


def test_ftrl_by_hand():
    m = langid.Ftrl(2)
    m.learn(np.array([3]), np.array([1.0]), 0)
    # From zero weights the gradient is p - y = (-0.5, 0.5); its first step leaves z = g and n = g * g.
    assert m.z[3] == pytest.approx([-0.5, 0.5]) and m.n[3] == pytest.approx([0.25, 0.25])
    want = (0.5 - langid.L1) / ((langid.BETA + 0.5) / langid.ALPHA + langid.L2)
    assert m.weights(np.array([3]))[0] == pytest.approx([want, -want])


def test_temperature():
    luck = np.random.default_rng(1)
    y = luck.integers(0, 3, 4000)
    logits = np.eye(3)[y] * 1.0
    flip = luck.random(4000) < 0.3
    logits[flip] = np.eye(3)[luck.integers(0, 3, flip.sum())]
    t = langid.temperature(logits * 10, y)
    best = min((-np.log(langid.softmax(logits * 10 / s)[np.arange(4000), y]).mean(), s) for s in np.exp(np.linspace(-2, 3, 400)))[1]
    assert math.isclose(t, best, rel_tol=0.05)


def test_copies_do_not_break_the_bound_of_the_sample(documents, monkeypatch):
    monkeypatch.setattr(langid, "PER_LANGUAGE", 60)
    rows = texts(600)
    copies = [(1000 + i, "the same text again and again", "en") for i in range(600)]
    repeated = [(5000, "one row many times", "de")] * 600
    known = documents(*rows, *copies, *repeated).select("doc_id", "text", "lang")
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    got = langid.sampled(known, sizes).collect()
    per = Counter(r.lang for r in got)
    assert 30 < per["en"] < 100 and per["de"] < 100 and per["fr"] < 100
    assert sum(r.doc_id == 5000 for r in got) <= 1
    # Copies are spread over the shards.
    assert len({r.shard for r in got if r.text == copies[0][1]}) > 4
