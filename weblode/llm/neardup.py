"""MinHash near-duplicates with sequential Bayesian verification.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a document's set is its distinct five-word shingles (the whole sequence
as one when it has fewer words).  Two documents are linked when 100 * |A and B| >= 75 * |A or B|.

1. Documents with the same words form one class, so copies are never paired.
2. ``BANDS`` bands of ``ROWS`` minima each deal the classes into buckets.  A pair at similarity 0.75 misses all of them with a probability of
   ``(1 - 0.75**4)**32``, about 5e-6.
3. In ``HUB_ROUNDS`` rounds every class meets one other: of the first members of its buckets that with which it shares most of them. What that leaves
   unconnected meets all other members of its bucket that it is not connected with, in blocks of ``BLOCK_MEMBERS`` compared inside a task; the largest
   connected part of a bucket is not compared with itself.  A group of thousands of copies makes no row for each of its pairs.
4. A pair's signatures are compared batch by batch.  After n values with m equal the similarity has the posterior Beta(1 + m, 1 + n - m); the pair
   is dropped as soon as P(similarity >= 0.75) is below ``MISS``.
5. Survivors are verified on their full sets.  Sets of up to ``SENT_SET`` shingles travel with the blocks and are verified where the pair is found: only
   links that connect something leave a block.  Pairs with a larger set meet their sets in a join, the likeliest partner of each member first; pairs that
   links have connected by then need no test.
6. Components come from alternating large-star and small-star steps, written down after each round.

Shingles stand as 64-bit values (polynomials over 64-bit word hashes), compared within one pair only.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from weblode.llm.common import blocks, mix64, odd_numbers, written

WORDS = 5
LEAST = 75
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 32
MISS = 1e-6
BLOCK_CHARS = 1 << 21
BLOCK_MEMBERS = 1024
#: Rounds in which a class meets one first member; the blocks do what they leave.
HUB_ROUNDS = 2
#: Shingles up to which a set goes into its blocks, 8 KB; pairs with a larger one are verified by a join.
SENT_SET = 1024


class Hashes(dict):
    """A memory of word hashes."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """The hashes of all runs of k words."""
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        h = np.full(n, k, np.uint64)
        for i, m in enumerate(odd_numbers(k, 7)):
            h += mix64(words[i : i + n] + np.uint64(i)) * m
    return mix64(h)


def shingle_sets(texts: list[str | None], known: Hashes) -> list[np.ndarray]:
    """Per text its distinct five-word shingles, sorted; the runs of all texts are hashed at once and those across texts left out."""
    if len(known) > 200_000:  # only a memory of hashes, not of decisions
        known.clear()
    lists = [word_list(t) for t in texts]
    ends = list(itertools.accumulate(map(len, lists), initial=0))
    words = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(lists)), np.uint64, ends[-1])
    full = windows(words, WORDS) if len(words) >= WORDS else words[:0]
    out = []
    for a, b in itertools.pairwise(ends):
        if b - a >= WORDS:
            h = np.sort(full[a : b - WORDS + 1])
            out.append(h[np.append(True, h[1:] != h[:-1])])
        else:
            out.append(windows(words[a:b], b - a) if b > a else words[:0])
    return out


A, B = ((odd_numbers(HASHES, seed) >> np.uint64(32)).astype(np.uint32) for seed in (11, 13))
A |= np.uint32(1)


def signature(s: np.ndarray) -> np.ndarray:
    """HASHES minima, as 32-bit values."""
    out = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 512):
        h = x[i : i + 512, None] * A
        h += B
        out = np.minimum(out, h.min(0))
    return out


def normal(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, joined by one blank."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, "[\\x20\\x09-\\x0D]+", " "))


def named(docs: DataFrame) -> DataFrame:
    """Add the 128-bit name of a document's word sequence; null without words."""
    # Inside a one-element array the words are worked out once, however often they are used.
    hashed = F.transform(F.array(normal(F.col("text"))), lambda words: F.when(words != "", F.unhex(F.md5(words.cast("binary")))))
    return docs.withColumn("name", F.get(hashed, F.lit(0)))


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def sign(batches):
    """Per document the size and the signature of its set; copies in a task are worked out once."""
    known, seen = Hashes(), {}
    for batch in batches:
        names = batch.column("name").to_pylist()
        new = {}
        for i, name in enumerate(names):
            if name not in seen:
                new.setdefault(name, i)
        texts = batch.column("text").take(pa.array(new.values(), pa.int64())).to_pylist()
        for a, b in blocks(texts, BLOCK_CHARS):
            for name, s in zip(list(new)[a:b], shingle_sets(texts[a:b], known), strict=True):
                seen[name] = len(s), signature(s).view(np.int32)
        flat = np.concatenate([seen[n][1] for n in names]) if names else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, HASHES, dtype=np.int32), pa.array(flat))
        sizes = pa.array([seen[n][0] for n in names], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("name"), sizes, lists], ["doc_id", "name", "n_shingles", "sig"])
        if len(seen) > 2000:  # only a memory of results
            seen.clear()


def members(batches):
    """Per class its full set."""
    known = Hashes()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in blocks(texts, BLOCK_CHARS):
            sets = [s.view(np.int64) for s in shingle_sets(texts[a:b], known)]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))], ["node", "members"])


def tail(m: int, n: int, s: float) -> float:
    """P(similarity >= s) after m of n values were equal, from a flat prior: a binomial sum."""
    return sum(math.exp(math.lgamma(n + 2) - math.lgamma(j + 1) - math.lgamma(n + 2 - j) + j * math.log(s) + (n + 1 - j) * math.log(1 - s)) for j in range(m + 1))


@functools.cache
def least_equal(miss: float = MISS) -> list[tuple[int, int]]:
    """(values compared so far, how many of them must be equal) after each batch."""
    return [(n, next(m for m in range(n + 1) if tail(m, n, LEAST / 100) >= miss)) for n in range(BATCH, HASHES + 1, BATCH)]


def equal_values(a: str, b: str, start: int, size: int) -> Column:
    pairs = F.zip_with(F.slice(a, start + 1, size), F.slice(b, start + 1, size), lambda x, y: (x == y).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x)


def pruned(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) that no batch of signature values rules out, with their number of equal values."""
    both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(
        sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b"
    )
    so_far = F.lit(0)
    for n, least in least_equal():
        # Each filter stands on its own batch count, so a pair that fails early is compared no further.
        both = both.withColumn("_m", so_far + equal_values("sig_a", "sig_b", n - BATCH, BATCH)).filter(F.col("_m") >= least)
        so_far = F.col("_m")
    return both.select("a", "b", F.col("_m").alias("equal"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("set_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("members").alias("set_b")), "b"
    )
    inter = F.size(F.array_intersect("set_a", "set_b"))
    return both.filter(100 * inter >= LEAST * (F.size("set_a") + F.size("set_b") - inter)).select("a", "b")


def components(links: DataFrame, what: str = "links") -> DataFrame:
    """(node, comp) for every node of a link, comp the smallest node reachable: large-star and small-star steps until nothing changes."""
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), what)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
        edges = written(small.filter("a <> b").distinct(), what)
        # Done when the edges are stars: no node has two smaller partners, or one that has a smaller one itself.
        ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
        if ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").isEmpty():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


#: Ids up to which a list of classes goes to the documents, about 20 MB; a longer one meets them in a shuffle.
SENT = 200_000


def full_sets(docs: DataFrame, need: DataFrame) -> DataFrame:
    """(node, members) of classes (node, rep, name), from the texts of their first documents."""
    need = written(need, "needed")
    need = F.broadcast(need) if need.count() <= SENT else need.hint("shuffle_hash")
    by_id = docs.join(need.filter("rep is not null").withColumnRenamed("name", "_name"), F.col("doc_id") == F.col("rep"))
    by_id = named(by_id.select("node", "text", "_name")).filter("name = _name").select("node", "text")
    by_name = named(docs.filter("doc_id is null")).join(need.filter("rep is null"), "name").select("node", "text")
    texts = by_id.unionByName(by_name)
    rows = written(texts.mapInArrow(members, "node long, members array<long>"), "members")
    # Repeated rows of one id give their class again; only where there are such is it worth a shuffle of the sets.
    if rows.groupBy("node").count().filter("count > 1").isEmpty():
        return rows
    return written(rows.groupBy("node").agg(F.first("members").alias("members")), "members")


def bucket_rows(classes: DataFrame) -> DataFrame:
    """(bucket, node, size, first) of buckets with two classes at least."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.slice("sig", i * ROWS + 1, ROWS)) for i in range(BANDS)])
    deals = classes.select("node", F.explode(keys).alias("bucket"))
    shared = deals.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first")).filter("size > 1")
    return written(deals.join(shared, "bucket"), "buckets")


def nearest_first(rows: DataFrame, tried: DataFrame | None) -> DataFrame:
    """Per class b the first member a it shares most buckets of (bucket, node, first) with, pairs already tried aside: one row a class."""
    shared = rows.filter("node > first").groupBy(F.col("first").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    if tried is not None:
        shared = shared.join(tried, ["a", "b"], "left_anti")
    return shared.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")


def open_buckets(deals: DataFrame, comps: DataFrame) -> DataFrame:
    """The rows of buckets that hold two components at least, with comp; per bucket its component of most members (major), that of its first
    member (lead), its size and the number of members beside the major one (minors)."""
    of = deals.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    parts = of.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"))
    mixed = parts.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("parts"), F.max_by("comp", F.struct("n", "comp")).alias("major"), F.min_by("comp", "low").alias("lead"), (F.sum("n") - F.max("n")).alias("minors")
    )
    return of.join(mixed.filter("parts > 1").drop("parts"), "bucket")


def blocked(rows: DataFrame) -> DataFrame:
    """Pairs (a, b, equal, sure) of not yet connected members of a bucket, from (bucket, node, comp, major, minors, size, sig, members).

    One of two unconnected members lies beside the bucket's major component, so those (left) meet all (right).  Both sides are cut into blocks of about
    ``BLOCK_MEMBERS``, and every two blocks meet in a task of their own, which compares signatures batch by batch and verifies what no batch rules out
    on the sets that were sent.  It gives out links that connect something (sure) and the pairs that lack a set.
    """
    lefts, rights = (F.ceil(F.col(c) / BLOCK_MEMBERS).cast("int") for c in ("minors", "size"))
    h = F.xxhash64("node")
    minor = F.col("comp") != F.col("major")
    cell = lambda x, y, left: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(left).alias("left"))
    as_left = F.transform(F.sequence(F.lit(0), rights - 1), lambda y: cell(F.pmod(h, lefts), y, True))
    as_right = F.transform(F.sequence(F.lit(0), lefts - 1), lambda x: cell(x, F.pmod(h, rights), False))
    rows = rows.select("bucket", F.explode(F.when(minor, F.concat(as_left, as_right)).otherwise(as_right)).alias("cell"), minor.alias("minor"), "node", "comp", "sig", "members")
    rows = rows.select("bucket", "cell.*", "minor", "node", "comp", "sig", "members")
    # Few bytes and much work: a stated number of partitions, which are not merged by their size.
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket", "x", "y")
    pairs = rows.groupBy("bucket", "x", "y").applyInArrow(compare_blocks, "a long, b long, equal int, sure boolean")
    return pairs.groupBy("a", "b").agg(F.max("equal").alias("equal"), F.max("sure").alias("sure"))


class Sets:
    """The sets of a block's rows, null where they were not sent, as runs of small whole numbers."""

    def __init__(self, lists: pa.ListArray):
        self.sent = lists.is_valid().to_numpy(zero_copy_only=False)
        self.size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        values, self.codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        self.ends = np.cumsum(self.size)
        self.mark = np.zeros(len(values), np.int32)

    def of(self, i: int) -> np.ndarray:
        return self.codes[self.ends[i] - self.size[i] : self.ends[i]]

    def similar(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the others whose sets are similar enough to that of i."""
        mine, sizes = self.size[i], self.size[others]
        near = 100 * np.minimum(mine, sizes) >= LEAST * np.maximum(mine, sizes)
        others, sizes = others[near], sizes[near]
        if not len(others):
            return others
        self.mark[self.of(i)] = 1
        shared = np.add.reduceat(self.mark[np.concatenate([self.of(j) for j in others])], np.cumsum(sizes) - sizes)
        self.mark[self.of(i)] = 0
        return others[100 * shared >= LEAST * (mine + sizes - shared)]


def compare_blocks(key: tuple, rows: pa.Table) -> pa.Table:
    node, part, minor, is_left = (rows.column(c).to_numpy() for c in ("node", "comp", "minor", "left"))
    part = part.copy()  # grows together with the links found here
    sig = rows.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, HASHES)
    sets = Sets(rows.column("members").combine_chunks())
    left, right = np.flatnonzero(is_left), np.flatnonzero(~is_left)
    limits = least_equal()
    # The first batch by the lowest bytes of its values: equal values have equal bytes, so no pair is lost that the values would keep.
    low = np.ascontiguousarray(sig[:, :BATCH].astype(np.uint8).T)
    out = []

    def put(i: int, j: int, equal: int, sure: bool) -> None:
        out.append((min(node[i], node[j]), max(node[i], node[j]), equal, sure))

    for at in range(0, len(left), 128):
        some = left[at : at + 128]
        close = np.zeros((len(some), len(right)), np.uint8)
        for column in low:
            close += column[some][:, None] == column[right][None]
        keep = (close >= limits[0][1]) & (part[some][:, None] != part[right][None])
        # Two members beside the major component meet twice, once on each side.
        keep &= ~minor[right][None] | (node[some][:, None] < node[right][None])
        i, j = np.nonzero(keep)
        i, j = some[i], right[j]
        equal = np.zeros(len(i), np.int64)
        for n, least in limits:
            equal += (sig[i, n - BATCH : n] == sig[j, n - BATCH : n]).sum(1)
            likely = equal >= least
            i, j, equal = i[likely], j[likely], equal[likely]
        starts = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else []
        for a, b in itertools.pairwise([*starts, len(i)]):
            x, others = i[a], j[a:b]
            whole = sets.sent[others] & sets.sent[x]
            for y in sets.similar(x, others[whole & (part[others] != part[x])]):
                if part[y] != part[x]:
                    put(x, y, HASHES, True)
                    part[part == part[y]] = part[x]
            for y, e in zip(others[~whole], equal[a:b][~whole], strict=True):
                if part[y] != part[x]:
                    put(x, y, e, False)
    return pa.table(list(zip(*out, strict=True)) or [[]] * 4, schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("equal", pa.int32()), ("sure", pa.bool_())]))


def connected(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, comp) of linked classes, from (node, rep, name, sig)."""
    deals = bucket_rows(classes)
    some = deals.select("node").distinct()
    sigs = written(classes.select("node", "sig").join(some, "node", "left_semi"), "sigs")
    sets = full_sets(docs, classes.select("node", "rep", "name").join(some, "node", "left_semi"))
    comps = classes.sparkSession.createDataFrame([], "node long, comp long")
    links = tried = None

    def labelled(pairs: DataFrame) -> DataFrame:
        for x in ("a", "b"):
            pairs = pairs.join(comps.select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}")), x, "left").withColumn(f"comp_{x}", F.coalesce(f"comp_{x}", x))
        return pairs.filter("comp_a <> comp_b").drop("comp_a", "comp_b")

    def linked(more: DataFrame) -> None:
        nonlocal links, comps
        if not more.isEmpty():
            links = more if links is None else links.unionByName(more)
            comps = components(links)

    def connect(pairs: DataFrame) -> bool:
        pairs = written(pairs, "tested")
        if pairs.isEmpty():
            return False
        linked(written(verified(pairs, sets), "verified"))
        return True

    for _ in range(HUB_ROUNDS):
        # After the first round only buckets that hold two components, and of them what is not connected with the first member.
        rows = deals if tried is None else open_buckets(deals, comps).filter("comp <> lead")
        pairs = written(nearest_first(rows, tried), "hubs")
        connect(pruned(pairs, sigs).select("a", "b"))
        tried = pairs if tried is None else tried.unionByName(pairs)
    small = sets.filter(F.size("members") <= SENT_SET)
    found = written(blocked(open_buckets(deals, comps).join(sigs, "node").join(small, "node", "left")), "blocks")
    linked(found.filter("sure").select("a", "b"))
    left = written(labelled(found.filter("not sure")), "unsure")
    best = left.groupBy("b").agg(F.max_by("a", "equal").alias("a")).select("a", "b")
    # The likeliest partners first; what they connect needs no test.
    if connect(best):
        connect(labelled(left.join(best, ["a", "b"], "left_anti").select("a", "b")))
    return comps


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, name (of the word sequence, null without words), n_shingles, comp (label of the group, null without words), component_id."""
    docs = docs.select("doc_id", "text")
    rows = written(named(docs).mapInArrow(sign, "doc_id long, name binary, n_shingles long, sig array<int>"), "signatures")
    classes = rows.filter("name is not null").groupBy("name").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    # A node per word sequence: an id that stands for several texts links none of them.
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    comps = connected(docs, classes)
    # Per class the smallest id of its component; classes without links are their own.
    of = classes.select("name", "rep", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = of.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of = of.join(least, "comp").select("name", "comp", "component_id")
    out = rows.select("doc_id", "name", "n_shingles").join(of, "name", "left")
    component = F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "name", "n_shingles", "comp", component.alias("component_id"))


def groups(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id).

    Null texts and texts without words have an empty set and stand alone.  A document without an id takes part, but never names a
    group that has an id; it is kept when its whole group has none.  Repeated rows come out repeated; several texts under one id are linked each for
    itself and come out with one row each.  An empty table gives no rows.
    Other columns are ignored.
    """
    return grouped(docs).select("doc_id", "n_shingles", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, all their columns, one of each group: that with the smallest id, of repeated rows one.  Documents without words stay."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "name")
    first = grouped(docs).filter("name is not null").groupBy("comp").agg(F.min(order).alias("_w"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_key")
    first = written(first.select("_w.doc_id", F.col("_w.name").alias("_name")).select("_name", key), "firsts")
    mine = named(docs.select(F.struct("*").alias("_row"), "doc_id", "text")).select("_row", F.col("name").alias("_name"), key)
    best = mine.filter("_name is not null").join(first, ["_name", "_key"]).dropDuplicates(["_name", "_key"])
    return best.select("_row.*").unionByName(mine.filter("_name is null").select("_row.*"))
