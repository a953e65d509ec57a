import hashlib

from hypothesis import given, settings, strategies as st
from oddities import ROWS

from weblode.llm import merkle


def edited_texts(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    texts = [t for _, t in rows]
    return [(i, len(t), t[: len(t) - len(t) // 2] + n[: len(t) // 2]) for (i, t), n in zip(rows, texts[1:] + texts[:1])]


def check(rows, got):
    want = sorted((i or -1, n, hashlib.sha256(e.encode()).hexdigest()) for i, n, e in edited_texts(rows))
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in got) == want


def test_next_document_across_parts(documents):
    rows = [(i * 3, f"text {i} " + "word " * (i % 7)) for i in range(60)]
    got = merkle.fingerprints(documents(*rows), part_bytes=200).collect()
    check(rows, got)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_odd_rows(documents):
    got = merkle.fingerprints(documents(*ROWS)).collect()
    check(ROWS, got)
    prints = {}
    for r in got:
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert prints[1] == prints[2] and prints[5] == prints[6] == prints[7]
    assert len({frozenset(p) for i, p in prints.items() if i}) == len(prints) - 1 - 3


def test_few_rows(documents):
    assert merkle.fingerprints(documents((1, "x")).filter("false")).count() == 0
    only = merkle.fingerprints(documents((1, "one two three four"))).collect()
    assert len(only) == 1 and only[0].near_next == 1.0


def test_likeness_follows_the_share():
    base = " ".join(f"word{i}" for i in range(4000))
    half = " ".join(f"word{i}" for i in range(2000)) + " " + " ".join(f"other{i}" for i in range(2000))
    other = " ".join(f"third{i}" for i in range(4000))
    prints = [merkle.fingerprint(t, s) for t, s in zip((base, half, other), merkle.sketches([base, half, other]))]
    assert merkle.alike(prints[0], prints[0]) == 1
    assert 0.3 < merkle.alike(prints[0], prints[1]) < 0.7
    assert merkle.alike(prints[0], prints[2]) < 0.1


def test_edits_are_located():
    lines = [f"line number {i}" for i in range(100)]
    new = list(lines)
    new[40], new[77] = "changed", "changed too"
    assert merkle.changed("\n".join(lines), "\n".join(new)) == [(40, 41), (77, 78)]
    assert merkle.changed("a\nb", "a\nb") == []


def test_small_shares_and_small_edits_are_seen():
    lines = lambda name, n: [" ".join(f"{name}{i}x{j}" for j in range(8)) for i in range(n)]
    long = lines("a", 2000)
    shared = lines("b", 1960) + long[500:540]
    slight, more = list(long), list(long)
    slight[700] = "another line"
    more[700:720] = lines("c", 20)
    rows = merkle.compared([1, 2, 3, 4, 5], ["\n".join(x) for x in (long, shared, long, slight, more)])
    assert 0.015 < rows["near_next"][0] < 0.025 and rows["near_next"][0] == rows["near_next"][1]
    assert 1 - 2 / 2000 < rows["near_next"][2] < 1
    assert 0.985 < rows["near_next"][3] < 0.995


def test_likeness_of_leaves_and_order():
    a, b = merkle.branches("one\ntwo words"), merkle.branches("two words\none")
    assert merkle.likenesses([(a, a), (merkle.branches(""), a), (merkle.branches(""), merkle.branches("\n"))]) == [1.0, 0.0, 0.0]
    assert 0.8 < merkle.likenesses([(a, b)])[0] < 1
    line = [f"word{i}" for i in range(4000)]
    other = line[:3800] + [f"new{i}" for i in range(200)]
    near = merkle.likenesses([tuple(merkle.branches(" ".join(x)) for x in (line, other))])
    assert 0.93 < near[0] < 0.97


def test_leaves_do_not_depend_on_the_text_before():
    texts = ["a b c d e f g h", "to be or not to be"]
    for before in ("x", "yz", "long before"):
        assert [s.tolist() for s in merkle.sketches([before, *texts])[1:]] == [s.tolist() for s in merkle.sketches(texts)]


@given(st.text(max_size=60), st.text(max_size=60))
@settings(max_examples=100, deadline=None)
def test_roots_test_equality(a, b):
    assert (merkle.tree(a)[0] == merkle.tree(b)[0]) == (a == b)
