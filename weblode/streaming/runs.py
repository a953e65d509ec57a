"""Running a stream over what is there, and result folders that stay whole on replay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def table_stream(spark: SparkSession, root: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """The files of one table as a stream, be the table one file or a folder of them.

    A stream takes a plain path for a folder; a path with a pattern may lead to either.
    """
    schema = spark.read.parquet(f"{root}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("basePath", root).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{root}/{name}.parque[t]")


def run_available(stream: DataFrame, folder: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process everything that is available, then stop; the checkpoint is kept in the folder.

    Rows that came too late for the watermark are counted per batch, from the
    run's own metrics, under ``dropped``.
    """
    spark = stream.sparkSession
    progress = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(progress)
    spark.conf.set(progress, "1000000")
    try:
        q = (
            stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(progress, before)
    q.awaitTermination()
    counts = {p["batchId"]: sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"]}
    for n in counts:
        spark.createDataFrame([(counts[n],)], "rows long").write.mode("overwrite").parquet(f"{folder}/dropped/batch={n}")


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, rows): how many rows of each batch came too late for the watermark."""
    if not exists(spark, f"{folder}/dropped"):
        return spark.createDataFrame([], "batch long, rows long")
    return spark.read.schema("rows long, batch long").parquet(f"{folder}/dropped").select("batch", "rows")


def exists(spark: SparkSession, path: str) -> bool:
    """Is there anything to read at the path, in whatever store it lies?"""
    try:
        spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(path).select("path").limit(1).collect()
    except AnalysisException:
        return False
    return True


def write_batch(df: DataFrame, folder: str, batch_id: int) -> None:
    """One folder per batch: a replayed batch overwrites its own rows and no others."""
    df.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")


def read_rows(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("basePath", f"{folder}/rows")
    if schema:
        reader = reader.schema(schema + ", batch long")
    return reader.parquet(f"{folder}/rows").withColumn("batch", F.col("batch").cast("long"))


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows written in update mode, the last version of each key."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
