import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from oddities import ROWS

from weblode.llm import neardup


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """(n_shingles, component_id) by id, from all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def planted(seed=3):
    luck = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    fresh = lambda n: [luck.choice(vocabulary) for _ in range(n)]
    rows = [(i, " ".join(fresh(luck.randint(1, 120)))) for i in range(150)]
    base = fresh(100)
    for i in range(150, 230):  # near copies of one text, some beyond the limit
        w = list(base)
        for _ in range(luck.randint(0, 7)):
            w[luck.randrange(len(w))] = luck.choice(vocabulary)
        rows.append((i, " ".join(w)))
    w = fresh(80)
    for i in range(230, 260):  # a chain: each like the one before
        w = list(w)
        w[luck.randrange(len(w))] = luck.choice(vocabulary)
        rows.append((i, " ".join(w)))
    passage = fresh(40)
    rows += [(i, " ".join(passage + fresh(luck.randint(10, 60)))) for i in range(260, 330)]  # a common passage
    luck.shuffle(rows)
    return rows


def test_against_all_pairs(documents):
    rows = planted()
    got = {r.doc_id: r for r in neardup.groups(documents(*rows)).collect()}
    want = brute(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_blocks_of_a_large_bucket(documents, monkeypatch):
    """With tiny blocks every bucket is cut, and the result is the same."""
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 3)
    rows = planted(seed=21)
    got = {r.doc_id: r.component_id for r in neardup.groups(documents(*rows)).collect()}
    assert got == {i: top for i, (_, top) in brute(rows).items()}


def test_odd_rows(documents):
    got = [tuple(r) for r in neardup.groups(documents(*ROWS)).collect()]
    assert len(got) == len(ROWS)
    by_id = {r[0]: r for r in got}
    assert by_id[1] == (1, 0, 1, True) and by_id[2] == (2, 0, 2, True) and by_id[3] == (3, 0, 3, True)
    assert by_id[6][2:] == (5, False) and sorted(r[2] for r in got if r[0] == 7) == [5, 5]
    assert by_id[9][1] == 1 and by_id[4] == (4, 1, 4, True)
    assert sorted((r[1], r[2], r[3]) for r in got if r[0] is None) == [(0, None, True), (5, None, True)]


def test_empty_table(documents):
    assert neardup.groups(documents((1, "x")).filter("false")).count() == 0


def test_one_of_each(documents):
    df = documents(*ROWS)
    got = neardup.one_of_each(df)
    assert got.columns == df.columns
    ids = sorted((r.doc_id for r in got.collect()), key=lambda x: (x is None, x or 0))
    assert ids == [1, 2, 3, 4, 5, 8, 9, 10, 11, 12, None, None]


@given(st.lists(st.integers(0, 30), min_size=0, max_size=40))
@settings(max_examples=50, deadline=None)
def test_shingle_sizes(numbers):
    text = " ".join(f"t{n}" for n in numbers)
    assert len(neardup.shingle_sets(["a b", text, None, text], neardup.Hashes())[3]) == len(shingle_set(text))


def test_posterior_bounds():
    # A pair at the limit is hardly ever dropped: the binomial chance of too few equal values is small.
    import math

    for n, least in neardup.least_equal():
        below = sum(math.comb(n, k) * 0.75**k * 0.25 ** (n - k) for k in range(least))
        assert below < 1e-4
        assert least > 0.3 * n or n < 64


def test_one_id_with_two_texts_links_neither(spark, documents):
    a, b = ("alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine")
    rows = [(5, a), (9, a), (5, b), (11, b), (20, "something else that stands alone here")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.groups(documents(*rows)).collect())
    assert got == [(5, 4, 5), (5, 5, 5), (9, 4, 5), (11, 5, 5), (20, 2, 20)]
    # Both texts stay, once each: the groups are two.
    assert sorted(r.text for r in neardup.one_of_each(documents(*rows)).collect()) == sorted([a, b, rows[-1][1]])
    swapped = [(5, a), (9, a), (5, b), (3, b)]
    got = sorted((r.doc_id, r.component_id) for r in neardup.groups(documents(*swapped)).collect())
    assert got == [(3, 3), (5, 3), (5, 5), (9, 5)]


def test_sets_too_large_to_be_sent_meet_in_a_join(documents, monkeypatch):
    rows = planted(seed=8)
    monkeypatch.setattr(neardup, "SENT_SET", 60)  # some of each
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.groups(documents(*rows)).collect()}
    assert got == brute(rows)


def test_a_block_gives_links_that_connect_and_pairs_without_sets():
    luck = random.Random(4)
    base = [luck.randrange(1 << 40) for _ in range(100)]
    sets = [sorted(base[i:] + [luck.randrange(1 << 40) for _ in range(i)]) for i in (0, 1, 2, 3, 40)]
    sets.append(None)
    sigs = [neardup.signature(np.array(s if s else base, np.uint64) << np.uint64(20)).view(np.int32) for s in sets]
    rows = [(n, n, True, left, sigs[n], sets[n]) for left in (True, False) for n in range(6)]
    schema = pa.schema([("node", pa.int64()), ("comp", pa.int64()), ("minor", pa.bool_()), ("left", pa.bool_()), ("sig", pa.list_(pa.int32())), ("members", pa.list_(pa.int64()))])
    table = pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    got = neardup.compare_blocks((), table).to_pylist()
    sure = {(r["a"], r["b"]) for r in got if r["sure"]}
    assert sure == {(0, 1), (0, 2), (0, 3)}  # what these connect is not linked again
    assert {(r["a"], r["b"]) for r in got if not r["sure"]} >= {(0, 5)} and all(r["b"] == 5 for r in got if not r["sure"])
