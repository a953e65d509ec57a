import base64
import gzip
import hashlib
import random

import pytest

from weblode.llm import warc

KIND = "page_id long, url string, html string, payload string, sha1 string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], KIND)


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


ROWS = [
    (5, "http://a/", "<p>same é</p>"), (3, "http://b/", "<p>same é</p>"), (9, None, "<p>same é</p>"), (1, "u\r\nWARC/1.1\r\n", "a\r\n\r\nWARC/1.1\r\nb\r\n\r\n"), (2, "x", None), (4, "x", ""),
    (None, "n", "<p>same é</p>"), (None, "n", None), (7, "big", "z" * 200_000), (7, "big", "z" * 200_000),
]


def test_round_trip(spark, tmp_path):
    got = warc.archived(pages(spark, ROWS), str(tmp_path / "w")).collect()
    first = {}
    for i, _, t in ROWS:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    want = []
    for i, _, t in ROWS:
        t = t or ""
        again = i != first[t]
        want.append((i or -1, len(t.encode()), digest(t), "revisit" if again else "response", first[t] if again else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)


def test_payloads_come_back(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(pages(spark, ROWS), path, compression="none")
    rows = warc.read(spark, path, with_payload=True).collect()
    assert all(r.gap_reason is None for r in rows)
    assert {r.payload.decode() for r in rows if r.record_type == "response"} == {t or "" for _, _, t in ROWS}


def test_small_payloads_stay_responses(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(pages(spark, ROWS), path, least_bytes=1)
    assert all(r.record_type == "response" for r in warc.read(spark, path).collect() if r.payload_bytes == 0)


def test_empty_table(spark, tmp_path):
    assert warc.archived(pages(spark, []), str(tmp_path / "w")).count() == 0


def record(i, text, digest_of=None):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + text.encode()
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Page-ID: {i}\r\nWARC-Payload-Digest: sha1:{digest(digest_of or text)}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def split(rows):
    rows = list(rows)
    return [r[1] for r in rows if r[-1] is None], [r[8:] for r in rows if r[-1]]


def test_damaged_records_are_quarantined():
    good = [record(i, f"text {i}") for i in range(4)]
    bad_length = good[1].replace(b"Content-Length: 25", b"Content-Length: 99")
    assert bad_length != good[1]
    for middle, why in ((bad_length, "no record end"), (record(1, "text 1", "other"), "payload digest differs"), (b"junk\r\n" * 5, "no version line"), (good[1][:-20], "no record end")):
        data = good[0] + middle + good[2] + good[3]
        ids, gaps = split(warc.salvage("f", data))
        assert ids == [0, 2, 3]
        assert gaps == [(len(good[0]), len(good[0] + middle), why)]
    ids, gaps = split(warc.salvage("f", good[0] + good[1][:-9]))
    assert ids == [0] and gaps == [(len(good[0]), len(good[0] + good[1]) - 9, "block is cut off")]


def test_damaged_members_are_quarantined():
    members = [gzip.compress(record(i, f"text {i} " + "".join(chr(97 + (j * j * i) % 26) for j in range(3000)))) for i in range(1, 5)]
    broken = bytearray(members[1])
    broken[len(broken) // 2 : len(broken) // 2 + 20] = b"\xff" * 20
    ids, gaps = split(warc.salvage("f", members[0] + bytes(broken) + members[2] + members[3]))
    assert ids == [1, 3, 4]
    assert any(a == len(members[0]) and b == len(members[0]) + len(broken) for a, b, _ in gaps)
    # Records of a member before the damage are recovered.
    whole = gzip.compress(b"".join(record(i, f"text {i} " * 5000) for i in range(5)))
    ids, gaps = split(warc.salvage("f", whole[: len(whole) // 2] + members[0]))
    assert ids[:2] == [0, 1] and ids[-1] == 1 and gaps


def test_records_before_a_damaged_byte_are_kept():
    luck = random.Random(3)
    whole = gzip.compress(b"".join(record(i, "".join(luck.choice("abcdefgh ") for _ in range(800))) for i in range(100)))
    # A byte of the checksum, and bytes inside: what comes before is whole.
    for at, n, least in ((len(whole) - 6, 1, 100), (len(whole) * 3 // 4, 40, 70)):
        broken = bytearray(whole)
        broken[at : at + n] = bytes(x ^ 255 for x in broken[at : at + n])
        ids, gaps = split(warc.salvage("f", bytes(broken)))
        assert ids[:least] == list(range(least)) and gaps


def test_written_archives_lose_only_the_damaged_record(spark, tmp_path):
    path = tmp_path / "w"
    luck = random.Random(4)
    rows = [(i, f"http://{i}/", "".join(luck.choice("abcdefgh ") for _ in range(3000))) for i in range(40)] + [(99, "é", "long " * 4_000_000)]
    warc.write(pages(spark, rows).coalesce(1), str(path))
    files = list(path.glob("part-*"))
    assert sorted(i for f in files for i in split(warc.salvage("f", f.read_bytes()))[0]) == [*range(40), 99]
    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\n") for f in files) == 41
    lost = []
    for f in files:
        data = bytearray(f.read_bytes())
        data[len(data) // 3] ^= 255
        ids = split(warc.salvage("f", bytes(data)))[0]
        lost += set(split(warc.salvage("f", f.read_bytes()))[0]) - set(ids)
    assert 1 <= len(lost) <= len(files)
    rows = list(warc.salvage("f", files[0].read_bytes()[:-50]))
    kind = "file string, page_id long, gap_start long, gap_end long, gap_reason string"
    read = spark.createDataFrame([(r[0], r[1], *r[8:]) for r in rows], kind)
    with pytest.raises(Exception, match="gap in f"):
        warc.whole(read).collect()


def test_files_without_records():
    for data in (b"", b"nothing at all", b"\x1f\x8b\x08", b"WARC/1.1\r\n", b"\x00" * 100):
        ids, gaps = split(warc.salvage("f", data))
        assert ids == [] and bool(gaps) == bool(data)
