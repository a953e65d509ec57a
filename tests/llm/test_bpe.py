import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from oddities import ROWS

from weblode.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def whole():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.fixture(scope="module")
def small():
    """A codec with tiny leaves, so that joins happen everywhere."""
    bpe.LEAF, kept = 3, bpe.LEAF
    yield bpe.codec(PATH, public_tokenizers.PATTERN)
    bpe.LEAF = kept


@given(text=st.text(alphabet=st.sampled_from(list("aé's ,.\n\t 1Ω漢\U0001f600theing  ")), max_size=120))
@settings(max_examples=400, deadline=None)
def test_same_as_whole(text, small, whole):
    ids = small.encode(text)
    assert ids == whole(text)
    assert small.decode(ids) == text.encode()


def test_seams(small, whole):
    for text in ("don't we'll I'm", "a" * 500, " " * 300 + "x", "x" + " " * 300, "ab\n\n\n cd  ef", "café " * 90, "one two " * 400):
        assert small.encode(text) == whole(text)


def test_joining_is_associative(small):
    a, b, c = "the cat ", "sat on", " the mat's edge"
    one = small.join(small.join(small.encode(a), small.encode(b)), small.encode(c))
    assert one == small.join(small.encode(a), small.join(small.encode(b), small.encode(c)))


def test_rows(documents, whole):
    got = bpe.digests(documents(*ROWS), PATH, public_tokenizers.PATTERN).collect()
    want = sorted((i or -1, len(ids := whole(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS)
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe.digests(documents((1, "x")).filter("false"), PATH, public_tokenizers.PATTERN).count() == 0
