import random

import numpy as np
from hypothesis import given, settings, strategies as st
from oddities import ROWS

from weblode.llm import decontam

luck = random.Random(6)
COMMON = ["the", "of", "and", "to", "in", "is"]
word = lambda: luck.choice(COMMON) if luck.random() < 0.4 else "".join(luck.choice("abcdefghijkl") for _ in range(luck.randint(4, 9)))
text = lambda n: " ".join(word() for _ in range(n))
ITEMS = [(i, text(luck.randint(15, 60))) for i in range(30)]


def table(spark, items):
    return spark.createDataFrame([(i, t, 0.0) for i, t in items], "item_id long, text string, score double")


def edited(item, share):
    w = item.split()
    for i in luck.sample(range(len(w)), int(share * len(w))):
        w[i] = word()
    return " ".join(w)


def test_copies_and_edits_are_found(documents, spark):
    clean = [(i, text(200)) for i in range(60)]
    exact = [(100 + i, f"{text(50)} {t.upper()}! {text(30)}") for i, t in ITEMS]
    close = [(200 + i, f"{text(50)} {edited(t, 0.15)} {text(30)}") for i, t in ITEMS]
    got = decontam.leaks(documents(*clean, *exact, *close), table(spark, ITEMS)).collect()
    found = {(r.doc_id, r.item_id): r for r in got}
    assert all((100 + i, i) in found and found[100 + i, i].score == 1 for i, _ in ITEMS)
    assert sum((200 + i, i) in found for i, _ in ITEMS) >= 29
    assert not any(d < 100 for d, _ in found)
    assert all(i == d % 100 for d, i in found)


def test_edited_copies_are_found_in_a_large_corpus(documents, spark):
    # Every third word replaced, in a corpus that has each word of the items hundreds of times.
    own = [w for _, t in ITEMS for w in t.split()]
    filler = [(1000 + i, " ".join(luck.sample(own, len(own)))) for i in range(300)]
    third = [(i, " ".join("qqq" if k % 3 == 2 else w for k, w in enumerate(t.split()))) for i, t in ITEMS]
    spread = [(100 + i, " ".join(x for w in t.split() for x in (w, "qqq"))) for i, t in ITEMS]
    got = decontam.leaks(documents(*filler, *third, *spread), table(spark, ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= {(k + i, i) for i, _ in ITEMS for k in (0, 100)}
    assert not any(r.doc_id < 1000 and r.doc_id % 100 != r.item_id for r in got)


def plain_leaks(doc, item):
    return plain_score(item, doc) >= decontam.LEAST * 2 * len(item)


@given(st.lists(st.integers(0, 12), min_size=3, max_size=14), st.lists(st.lists(st.integers(0, 14), max_size=30), min_size=1, max_size=4), st.randoms())
@settings(max_examples=300, deadline=None)
def test_no_alignment_is_lost(item, docs, chance):
    # Documents of their own and edited copies, against the plain alignment of all.
    docs = [*docs, [w for x in item for w in ([x] if chance.random() < 0.7 else [x, 20] if chance.random() < 0.5 else [chance.randint(0, 14)])]]
    items = decontam.Items([(0, " ".join(f"w{x}" for x in item))])
    items.seed(np.array([chance.randint(0, 9) for _ in items.number]))
    flat, starts = items.joined([" ".join(f"w{x}" for x in d) for d in docs])
    ends = [*(starts[1:] - 1), len(flat) - 1]
    got = {d for d, i, hits in items.chains(flat, starts) if decontam.match(items, flat[starts[d] : ends[d]], i, hits)}
    assert got == {d for d, x in enumerate(docs) if plain_leaks(x, item)}


def test_leaked_thousands_of_times(documents, spark):
    rows = [(i, f"{text(5)} {ITEMS[0][1]}") for i in range(800)] + [(1000, text(300))]
    got = decontam.leaks(documents(*rows), table(spark, ITEMS)).collect()
    assert {r.doc_id for r in got} == set(range(800))


def test_item_blocks(documents, spark, monkeypatch):
    monkeypatch.setattr(decontam, "ITEMS", 7)
    rows = [(i, t) for i, t in ITEMS]
    got = decontam.leaks(documents(*rows), table(spark, ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= {(i, i) for i, _ in ITEMS}


def test_odd_rows(documents, spark):
    items = [(1, None), (2, ""), (3, "!!!"), (4, "same words here and there again"), (None, "no id at all but words enough to count"), (5, "the"), (4, "same words here and there again")]
    got = decontam.leaks(documents(*ROWS), table(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(5, 4), (6, 4), (7, 4), (None, None)}
    assert sum(r.doc_id == 7 for r in got) == 4
    assert decontam.leaks(documents(*ROWS), table(spark, [])).count() == 0
    assert decontam.leaks(documents(*ROWS).filter("false"), table(spark, items)).count() == 0


def plain_score(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


@given(st.lists(st.integers(0, 4), min_size=1, max_size=14), st.lists(st.integers(0, 4), min_size=1, max_size=20))
@settings(max_examples=200, deadline=None)
def test_alignment(a, b):
    score, equal, first, last = decontam.align(np.array(a), np.array(b))
    assert score == plain_score(a, b)
    assert equal <= last - first and (score == 0 or plain_score(a, b[first:last]) == score)
