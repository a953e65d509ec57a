import random
from itertools import product

import numpy as np
import pytest
from oddities import ROWS

from weblode.llm import linecrf
from weblode.llm.common import bucket_of


def test_chain_against_all_labellings():
    luck = np.random.default_rng(2)
    counts = np.array([3, 1, 4, 2])
    score, move = luck.normal(size=10), luck.normal(size=(2, 2))
    good, pairs, log_sum = linecrf.chain(score, move, counts)
    first, total, at = np.zeros(10), 0.0, 0
    want_pairs = np.zeros((2, 2))
    for n in counts:
        z, marginal, moves = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in product((0, 1), repeat=int(n)):
            steps = np.zeros((2, 2))
            for a, b in zip(y, y[1:]):
                steps[a, b] += 1
            p = np.exp((score[at : at + n] * y).sum() + (move * steps).sum())
            z, marginal, moves = z + p, marginal + p * np.array(y), moves + p * steps
        first[at : at + n], total, want_pairs = marginal / z, total + np.log(z), want_pairs + moves / z
        at += n
    assert good == pytest.approx(first) and pairs == pytest.approx(want_pairs)
    assert log_sum == pytest.approx(total - len(counts) * np.log(2))  # each chain starts from an even chance


def corpus(n, seed=4):
    luck = random.Random(seed)
    word = lambda: "".join(luck.choice("abcdefgh") for _ in range(luck.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        bad = luck.random() < 0.3
        lines = []
        for _ in range(luck.randint(1, 8)):
            w = [word() for _ in range(luck.randint(4, 20))]
            kind = luck.randrange(3)
            lines.append(("!! ".join(x.upper() for x in w) if kind == 0 else " | ".join(w) if kind == 1 else " ".join(w[:1] * 15)) if bad else " ".join(w).capitalize() + ".")
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_held_out_accuracy(documents, spark):
    rows, labels = corpus(400)
    df, marks = documents(*rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in linecrf.scored(df, linecrf.trained(df, marks)).collect()}
    held = [i for i, _ in rows if bucket_of(i, 4) == 2]
    assert all(got[i].held_out for i in held) and sum(r.held_out for r in got.values()) == len(held)
    assert sum(got[i].predicted == labels[i][1] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


def test_odd_rows(documents, spark):
    rows, labels = corpus(80)
    df = documents(*rows, *[(1000 + (i or 500), t) for i, t in ROWS], (None, "x"))
    marks = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (1001, 1, 0), (1009, 0, 0)], "doc_id long, quality int, toxic int")
    model = linecrf.trained(df, marks)
    got = linecrf.scored(df, model).collect()
    assert len(got) == 81 + len(ROWS) and all(r.score is not None for r in got)
    same = {round(r.score, 12) for r in got if r.doc_id in (1001, 1002)}
    assert len(same) == 1
    keep = linecrf.kept(df, model)
    assert keep.columns == df.columns and keep.count() == sum(r.predicted for r in got)


def test_without_labels(documents, spark):
    df = documents((1, "x"), (2, None))
    for labels in ([], [(1, 1, 0)]):
        marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        scores = {r.score for r in linecrf.scored(df, linecrf.trained(df, marks)).collect()}
        assert len(scores) == 1 and (not labels or scores.pop() > 0.5)
    empty = df.filter("false")
    assert linecrf.scored(empty, linecrf.trained(empty, marks)).count() == 0
