"""Intake of responses, watched values, feed novelty, refusal rates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from weblode.operators.ordered import previous
from weblode.streaming.runs import exists, run_available, write_batch
from weblode.streaming.state import ROCKS, STORE, kept_before, places


def intake(stream: DataFrame, folder: str, extract: Callable[[DataFrame], DataFrame]) -> None:
    """Every new response goes through a batch extraction chain and is written at once."""
    run_available(stream, folder, lambda df, n: write_batch(extract(df), folder, n))


def watch(stream: DataFrame, folder: str, keys: list[str], order: list[str], bucket: Column, value: str, forget_ms: int | None = None) -> None:
    """Changes of a value per key, across batches and restarts.

    Two streams follow each other.  The first stages the rows of a batch and
    reduces them to one step per key, the batch's last value, so a hot key is
    one row from there on.  The second looks the steps up in the state store:
    for each it learns what was kept for the key before, with its place in the
    order, and keeps the newer one.  A batch reads and writes the state of its
    own keys, however many were ever seen.

    Rows are then compared inside buckets (``previous``), the first of a key
    with what was kept.  A row that comes no later than the kept place is late:
    it is neither a change nor the new value, and is set aside in ``late``,
    where it can be counted.  Replayed batches overwrite their own rows, and a
    replayed step gets the same answer.  ``forget_ms`` drops keys not seen for
    so long; their next row counts as a first one.
    """
    spark = stream.sparkSession
    kind = stream.schema[value].dataType
    boxed = T.StructType([T.StructField("value", kind)])
    step_schema = T.StructType([*[stream.schema[k] for k in keys], T.StructField("place", T.ArrayType(T.LongType())), T.StructField("value", T.StringType()), T.StructField("batch", T.LongType())])
    staged_schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])

    def stage(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/staged/batch={n}")
        rows = spark.read.schema(stream.schema).parquet(f"{folder}/staged/batch={n}")
        place = F.array(*places(rows, order))
        box = F.to_json(F.struct(F.col(value).alias("value")), {"ignoreNullFields": "false"})
        rows.groupBy(*keys).agg(F.max(place).alias("place"), F.max_by(box, place).alias("value")).write.mode("overwrite").parquet(f"{folder}/steps/batch={n}")

    def settle(steps: DataFrame, n: int) -> None:
        steps.write.mode("overwrite").parquet(f"{folder}/kept/run={n}")
        kept = spark.read.schema(steps.schema).parquet(f"{folder}/kept/run={n}")
        batches = [r.batch for r in kept.select("batch").distinct().collect()]  # those that one micro-batch took up
        rows = spark.read.schema(staged_schema).option("basePath", f"{folder}/staged").parquet(f"{folder}/staged").filter(F.col("batch").isin(batches))
        met = rows.join(kept.select(*keys, "batch", F.col("place").alias("_kept")), [*keys, "batch"])
        late = F.coalesce(F.array(*places(rows, order)) <= F.col("_kept"), F.lit(False))
        met.filter(late).drop("_kept", "batch").write.mode("overwrite").parquet(f"{folder}/late/batch={n}")
        initial = kept.select(*keys, "batch", F.from_json("value", boxed).alias("kept"))
        found = previous(met.filter(~late).drop("_kept"), [*keys, "batch"], order, bucket, F.col(value), "before", initial=initial)
        changed = F.col("before").isNull() | ~F.col("before.value").eqNullSafe(F.col(value))
        write_batch(found.filter(changed).select(*keys, *order, F.col("before.value").alias("old"), F.col(value).alias("new")), folder, n)

    run_available(stream, folder, stage)
    if not exists(spark, f"{folder}/steps"):
        return
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        steps = spark.readStream.schema(step_schema).parquet(f"{folder}/steps")
        run_available(kept_before(steps, keys, forget_ms), f"{folder}/state", settle)
    finally:
        spark.conf.set(STORE, before)


def novelty(items: DataFrame, key: list[str], ts: str, horizon: str) -> DataFrame:
    """Items not seen within the horizon.  Rows later than it are left out by the watermark; the run that writes them counts them (``runs.late_rows``)."""
    return items.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(key)


def rates(attempts: DataFrame, ts: str, window: str, slide: str | None, late: str, keys: list[str], refused: Column) -> DataFrame:
    """Requests and refusals per key and window; ``slide`` makes the windows overlap."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return attempts.withWatermark(ts, late).groupBy(*keys, w.alias("w")).agg(
        F.count("*").alias("requests"), F.count_if(refused).alias("refused")
    )


def bursts(attempts: DataFrame, ts: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Sessions of refused requests per key; run in append mode, each comes out once, when the watermark has passed its end, and leaves the state."""
    return attempts.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("refused"))


def open_bursts(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The sessions of ``bursts`` that a run in append mode left open, as they stand in its state after the last batch."""
    state = spark.read.format("statestore").load(f"{folder}/checkpoint")
    return state.select(*[f"value.{k}" for k in keys], F.col("value.session_window").alias("w"), F.col("value.count").alias("refused"))
