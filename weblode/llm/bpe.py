"""Byte-level BPE by monoid tree reduction.

A text is halved until its pieces have ``LEAF`` characters; pieces are encoded one by one and joined up the tree.  Only tokens near a
seam can change, so a join encodes a window around it anew.  The window grows until each of its ends is a *firm* cut: a token
that starts with a blank or line break after a token that ends with a visible ASCII character.  No match of the splitting
pattern holds a visible character followed by white space, whatever comes before or after, so the matches and with them the tokens beyond a firm
cut are those of the whole text.  A side without a firm cut goes into the window whole.  Joining is associative, the empty text is
neutral, and decoding concatenates up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weblode.llm.common import blocks

LEAF = 1024
#: Tokens that a window starts with on either side.
WINDOW = 8
BLOCK_CHARS = 256 << 10

VISIBLE = frozenset(range(0x21, 0x7F))
BREAKS = frozenset(b" \n")


class Codec:
    """A vocabulary of token ranks; ``split`` is the pattern whose matches are encoded separately."""

    def __init__(self, ranks: dict[bytes, int], split: str):
        import tiktoken

        self.tokens = {rank: token for token, rank in ranks.items()}
        self.piece: Callable[[str], list[int]] = tiktoken.Encoding("ranks", pat_str=split, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def firm(self, before: int, after: int) -> bool:
        return self.tokens[after][0] in BREAKS and self.tokens[before][-1] in VISIBLE

    def last_firm(self, ids: list[int]) -> int:
        """Where the last firm cut is, 0 if there is none; looks at a growing end of the tokens."""
        known, size = len(ids), WINDOW
        while known > 0:
            start = max(1, len(ids) - size)
            for i in range(known - 1, start - 1, -1):
                if self.firm(ids[i - 1], ids[i]):
                    return i
            known, size = (start if start > 1 else 0), size * 2
        return 0

    def first_firm(self, ids: list[int]) -> int:
        known, size = 1, WINDOW
        while known < len(ids):
            stop = min(len(ids), size)
            for i in range(known, stop):
                if self.firm(ids[i - 1], ids[i]):
                    return i
            known, size = max(stop, known), size * 2
        return len(ids)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left or right
        i, j = self.last_firm(left), self.first_firm(right)
        window = self.decode(left[i:] + right[:j]).decode("utf-8")
        middle = self.piece(window)
        del left[i:]
        left += middle
        left += right[j:]
        return left

    def encode(self, text: str) -> list[int]:
        if len(text) <= LEAF:
            return self.piece(text)
        half = len(text) // 2
        return self.join(self.encode(text[:half]), self.encode(text[half:]))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def codec(path: str, split: str) -> Codec:
    with open(path, "rb") as lines:
        return Codec({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, split)


def coded(docs: DataFrame, path: str, split: str) -> DataFrame:
    """Per document: doc_id, ids array<int>, decoded binary (the bytes the ids stand for).

    ``path`` names the rank file, which lies on every worker.  Null texts count as empty and have no ids.  Other columns are ignored.
    """

    def run(batches):
        c = codec(path, split)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in blocks(texts, BLOCK_CHARS):
                ids = [c.encode(t) for t in texts[a:b]]
                decoded = [c.decode(i) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"]
                )

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str, split: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids (decimal, joined by commas) and of the decoded bytes; on request the ids too.

    Worked out beside the tokens, so neither ids nor bytes are moved only to be hashed.
    """
    shape = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        # What earlier stages in this worker have freed goes back before the vocabulary is loaded.
        pa.default_memory_pool().release_unused()
        c = codec(path, split)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in blocks(texts, BLOCK_CHARS):
                sizes, of_ids, of_bytes, all_ids = [], [], [], []
                for t in texts[a:b]:
                    ids = c.encode(t)
                    sizes.append(len(ids))
                    of_ids.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                    of_bytes.append(hashlib.sha256(c.decode(ids)).hexdigest())
                    if with_ids:
                        all_ids.append(pa.array(ids, pa.int32()))
                out = [batch.column("doc_id").slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(of_ids), pa.array(of_bytes)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ends = np.cumsum([0, *sizes]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(ends, pa.concat_arrays(all_ids)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, shape + (", ids array<int>" if with_ids else ""))
