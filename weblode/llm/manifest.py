"""Merkle manifest of a table, by lag and lead windows.

A leaf is H of its row's fields; H is the lowercase hex sha256 of its inputs joined, digests as hex text.  Per group (the language) leaves ascend by
doc_id.  While a group has several nodes, every ``FAN`` consecutive ones become their H; the last run may be shorter, a run of one too.  The one left
is the group's subroot.  Subroots in the order of their groups give the root in the same way.

Slots (places in the group) are counted by ranges of (group, doc_id), so no task holds a group.  ``LEVELS`` levels at a time are worked out in blocks of
``FAN ** LEVELS`` slots: runs never cross a block, so a window over (group, block) holds all siblings, however many rows the group has.  At level l a
node stands in the row of its first leaf; its siblings stand ``m * FAN ** l`` rows before or after it, which is a lag or lead of fixed offset, masked by
the slot and by the run's length.  First children hash the parent.  Blocks then are the leaves of the next tier.  Paths come down the same way: a row's path is
that inside its block and that of the block.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weblode.llm.common import written

FAN = 2
LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SIDES = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the value's length in UTF-8 bytes, a colon and the value."""
    s = value.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(**other: Column) -> Column:
    """Digest of a row; ``other`` stands in for columns of that name."""
    return F.sha2(F.concat(*[field(other.get(c, F.col(c))) for c in FIELDS]), 256)


def ranked(nodes: DataFrame, *order: str) -> DataFrame:
    """Add slot (place in ``grp`` by ``order``, from 0) and size (rows of the group)."""
    keys = ["grp", *order]
    # Within a partition ids rise with the order; written down, they stay what they are.
    placed = written(nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33).alias("_part")
    w = Window.partitionBy("grp")
    # One row per partition and group: a large group has as many as there are partitions.
    runs = placed.groupBy("grp", part).agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("grp", "_part", (before - F.col("_low")).alias("_shift"), F.sum("_n").over(w).alias("size"))
    return placed.select("*", part).join(runs, ["grp", "_part"]).withColumn("slot", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def tier(nodes: DataFrame) -> DataFrame:
    """For (grp, slot, size, digest, ...): add block, path (siblings of up to ``LEVELS`` levels, lowest first) and top (the block's digest, in its first row)."""
    w = Window.partitionBy("grp", "block").orderBy("slot")
    nodes = nodes.withColumn("block", F.expr(f"slot div {FAN**LEVELS}")).withColumn("_d", F.col("digest"))
    for level in range(LEVELS):
        step = FAN**level
        # Level exists while several nodes of the group remain; its nodes stand in rows whose slot is a multiple of step.
        real, child = F.col("size") > step, F.expr(f"slot div {step} % {FAN}")
        around = {m: (F.lag if m < 0 else F.lead)("_d", abs(m) * step).over(w) for m in range(1 - FAN, FAN) if m}
        nodes = nodes.withColumns({f"_s{m}": F.when((child + m >= 0) & (child + m < FAN), c) for m, c in around.items()})
        left, right = (F.concat(*[F.coalesce(f"_s{m}", F.lit("")) for m in ms]) for ms in (range(1 - FAN, 0), range(1, FAN)))
        nodes = nodes.withColumn(f"_side{level}", F.when(real & (F.col("slot") % step == 0), F.struct(left.alias("left"), right.alias("right"))))
        parent = F.when(real, F.sha2(F.concat("_d", right), 256)).otherwise(F.col("_d"))
        nodes = nodes.withColumn("_d", F.when(F.col("slot") % (step * FAN) == 0, parent)).drop(*[f"_s{m}" for m in around])
    # The last row at or before a leaf that stands for a node is that of the leaf's ancestor.
    filled = w.rowsBetween(Window.unboundedPreceding, 0)
    sides = [F.last(f"_side{level}", ignorenulls=True).over(filled) for level in range(LEVELS)]
    nodes = nodes.withColumn("_sides", F.array(*sides)).withColumn("path", F.filter("_sides", lambda s: s.isNotNull()).cast(SIDES))
    return nodes.withColumnRenamed("_d", "top").drop("_sides", *[f"_side{level}" for level in range(LEVELS)])


def tree(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For ranked nodes: (the nodes with their whole path, one row (grp, digest) for the top of each group)."""
    tiers = []
    while True:
        rows = written(tier(nodes), "tier")
        tiers.append(rows)
        nodes = rows.filter(F.col("top").isNotNull() & (F.col("slot") % FAN**LEVELS == 0)).select(
            "grp", F.col("block").alias("slot"), F.expr(f"(size + {FAN**LEVELS - 1}) div {FAN**LEVELS}").alias("size"), F.col("top").alias("digest")
        )
        if nodes.filter("size > 1").isEmpty():
            break
    paths = None
    for rows in reversed(tiers):
        if paths is not None:
            above = paths.select("grp", F.col("slot").alias("block"), F.col("path").alias("_above"))
            rows = rows.join(above, ["grp", "block"]).withColumn("path", F.concat("path", "_above")).drop("_above")
        paths = rows
    return paths.drop("block", "top", "size"), nodes.select("grp", "digest")


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, digest, lambda d, s: F.sha2(F.concat(s.left, d, s.right), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, tampered (the leaf after 1 is added to n_chars, or null), path, subroot, root.

    ``path`` lists the siblings of each level from the leaf to the root as (left, right); a level without siblings has two empty texts.  Tampered are rows whose
    crc32 of the decimal id is a multiple of 7; rows without an id are not, and a null n_chars stays null.  Rows without a language form the first group; null ids come
    first in theirs.  Rows of one id are ordered by their leaves; repeated rows are leaves of their own.  Null fields differ from empty ones.  An empty table gives no
    rows.  Other columns are ignored.
    """
    marked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("+"), "lang"), F.lit("")).alias("grp"), "doc_id", leaf().alias("digest"),
        F.when(marked, leaf(n_chars=F.try_add("n_chars", F.lit(1)))).alias("tampered"),
    )
    rows, subroots = tree(ranked(leaves, "doc_id", "digest"))
    tops = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
    upper, roots = tree(ranked(tops, "name"))
    upper = upper.crossJoin(roots.select(F.col("digest").alias("root")))  # the one row of the root
    upper = written(upper.select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), F.col("path").alias("_above"), "root"), "subroots")
    return rows.join(upper, "grp").select("doc_id", F.col("digest").alias("leaf"), "tampered", F.concat("path", "_above").alias("path"), "subroot", "root")


def proofs(rows: DataFrame) -> DataFrame:
    """Per row of a manifest: doc_id, leaf, subroot, root, proof_sha256, folded_root (from the tampered leaf where there is one), verified."""
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s.left, s.right)), "")
    rows = rows.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def sql() -> str:
    """The same for DuckDB, over ``documents``: a recursion over levels, with crc32 bit by bit."""

    def row(n_chars: str) -> str:
        values = ["cast(doc_id as varchar)", "source", "lang", n_chars, "text"]
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in values) + ")"

    def levels(name: str, leaves: str) -> str:
        return f"""{name}_up as (
  select grp, slot, n, digest, 0 as level from {leaves}
  union all
  select grp, slot // 2, any_value((n + 1) // 2), sha256(string_agg(digest, '' order by slot)), any_value(level + 1) from {name}_up where n > 1 group by grp, slot // 2
), {name}_path as (
  select grp, slot as leaf_slot, slot, n, digest, 0 as level, '' as siblings, tampered as folded from {leaves}
  union all
  select p.grp, p.leaf_slot, p.slot // 2, (p.n + 1) // 2, '', p.level + 1, p.siblings || coalesce(s.digest, ''),
    case when p.slot % 2 = 0 then sha256(p.folded || coalesce(s.digest, '')) else sha256(s.digest || p.folded) end
  from {name}_path p left join {name}_up s on s.grp = p.grp and s.level = p.level and s.slot = xor(p.slot, 1::bigint)
  where p.n > 1
)"""

    crc = (
        "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(cast(doc_id as varchar)) + 1), lambda i: ascii(substr(cast(doc_id as varchar), i, 1))::bigint)), "
        "lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384::bigint * (x & 1)))), 4294967295::bigint)"
    )
    return f"""with recursive base as (
  select coalesce('+' || lang, '') as grp, doc_id, {row("cast(n_chars as varchar)")} as digest,
    case when doc_id is not null and {crc} % 7 = 0 then {row("cast(n_chars + 1 as varchar)")} end as changed from documents
), leaves as (
  select grp, doc_id, digest, coalesce(changed, digest) as tampered, count(*) over (partition by grp) as n,
    row_number() over (partition by grp order by doc_id nulls first, digest) - 1 as slot from base
), {levels("a", "leaves")}, tops as (
  select '' as grp, grp as name, digest, digest as tampered, count(*) over () as n, row_number() over (order by grp) - 1 as slot from a_up where n = 1
), {levels("b", "tops")}, done as (
  select l.grp, l.doc_id, l.digest, p.siblings, p.folded from leaves l join a_path p on p.grp = l.grp and p.leaf_slot = l.slot and p.n = 1
), last_levels as (
  select d.*, t.digest as subroot, t.slot, t.n, 0 as level from done d join tops t on t.name = d.grp
), top_path as (
  select grp, doc_id, digest, subroot, siblings, folded, slot, n, level from last_levels
  union all
  select p.grp, p.doc_id, p.digest, p.subroot, p.siblings || coalesce(s.digest, ''),
    case when p.slot % 2 = 0 then sha256(p.folded || coalesce(s.digest, '')) else sha256(s.digest || p.folded) end, p.slot // 2, (p.n + 1) // 2, p.level + 1
  from top_path p left join b_up s on s.level = p.level and s.slot = xor(p.slot, 1::bigint) where p.n > 1
)
select doc_id, digest as leaf, subroot, r.root, sha256(siblings) as proof_sha256, folded as folded_root, folded = r.root as verified
from top_path, (select digest as root from b_up where n = 1) r where n = 1"""
