"""Order-dependent look-ups that survive a hot key.

A plain window over a key puts all rows of the key into one task.  Here the
key is cut into buckets of the order column, windows run inside a bucket, and
one summary row per bucket carries the last value across.  The result is the
same as without buckets; only the summary is ever handled per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: Column, name: str,
    initial: DataFrame | None = None,
) -> DataFrame:
    """``lag(value)`` per key in the given order; ``bucket`` must not decrease along it.

    ``name`` becomes a struct with the field ``value``, null on the first row
    of a key, so that a null value and a missing row can be told apart.
    ``initial`` (keys, kept) holds such structs for the rows before the first;
    it meets the summaries, not the rows.
    """
    keys, order = list(keys), list(order)
    cut = df.withColumn("_bucket", bucket).withColumn("_box", F.struct(value.alias("value")))
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    rows = cut.withColumn("_near", F.lag("_box").over(inner))
    ends = cut.groupBy(*keys, "_bucket").agg(F.max_by("_box", F.struct(*order)).alias("_end"))
    carried = ends.withColumn("_far", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_bucket")))
    if initial is not None:
        carried = carried.join(initial, keys, "left").withColumn("_far", F.coalesce("_far", "kept")).drop("kept")
    joined = rows.join(carried.drop("_end"), [*keys, "_bucket"], "left")
    return joined.withColumn(name, F.coalesce("_near", "_far")).drop("_bucket", "_box", "_near", "_far")


def latest_before(
    points: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, payload: str, width: float, tie: str | None = None
) -> DataFrame:
    """As-of join: each point gets the payload of the latest mark at or before it.

    ``at`` is the numeric order column on both sides, ``tie`` orders marks of
    equal time (the last one counts); ``width`` is the size of a bucket.
    """
    keys = list(keys)
    slot = F.floor(F.col(at) / F.lit(width))
    order_of = lambda c: F.struct(F.col(at), F.col(c)) if c else F.struct(F.col(at))
    m = marks.select(*keys, at, (F.col(tie) if tie else F.lit(0)).alias("_tie"), F.col(payload).alias("_payload"))
    m = m.withColumn("_slot", slot)
    events = m.select(*keys, "_slot", at, "_tie", F.lit(0).alias("_side"), "_payload", F.lit(None).cast(
        points.select(F.struct(*points.columns)).schema[0].dataType).alias("_row"))
    rows = points.withColumn("_slot", slot).select(
        *keys, "_slot", at, F.lit(None).cast(m.schema["_tie"].dataType).alias("_tie"), F.lit(1).alias("_side"),
        F.lit(None).cast(m.schema["_payload"].dataType).alias("_payload"), F.struct(*points.columns).alias("_row"),
    )
    order = Window.partitionBy(*keys, "_slot").orderBy(at, "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    near = events.unionByName(rows).withColumn("_near", F.last("_payload", True).over(order)).filter("_side = 1")
    ends = m.groupBy(*keys, "_slot").agg(F.max_by("_payload", F.struct(F.col(at), F.col("_tie"))).alias("_end"))
    # Slots of points get the last mark of any earlier slot.
    slots = near.select(*keys, "_slot").distinct().withColumn("_want", F.lit(True))
    lasts = slots.join(ends, [*keys, "_slot"], "full")
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.withColumn("_far", F.last("_end", True).over(before)).filter("_want").select(*keys, "_slot", "_far")
    out = near.join(carried, [*keys, "_slot"], "left")
    return out.select("_row.*", F.coalesce("_near", "_far").alias(payload))


def islands(df: DataFrame, keys: Sequence[str], ts: str, gap_seconds: int) -> DataFrame:
    """Sessions of rows no further apart than the gap: (keys, start, end, rows).

    Rows are first folded per key and slot of the gap's length (rows of one
    slot always belong together), so the window sees slots, not rows.
    """
    keys = list(keys)
    second = F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)
    cut = df.select(*keys, F.col(ts).alias("_ts"), second.alias("_s"))
    folded = cut.groupBy(*keys, F.floor(F.col("_s") / gap_seconds).alias("_slot")).agg(
        F.min("_ts").alias("start"), F.max("_ts").alias("end"), F.min("_s").alias("_lo"), F.max("_s").alias("_hi"),
        F.count("*").alias("rows"),
    )
    order = Window.partitionBy(*keys).orderBy("_slot")
    marked = folded.withColumn(
        "_new", F.when(F.col("_lo") - F.lag("_hi").over(order) <= gap_seconds, 0).otherwise(1)
    ).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("rows").alias("rows")
    ).drop("_island")
