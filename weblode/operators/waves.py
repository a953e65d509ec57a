"""Iteration that survives lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``, else one inside its warehouse; never one of the machine's own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_waves"


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def durable(df: DataFrame, what: str = "wave") -> DataFrame:
    """Write a table to the shared folder and read it back: computed once,
    independent of the executors that made it, and of known size to the next join."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, what: str = "wave") -> tuple[DataFrame, int]:
    """The same, with the number of rows, counted while they are written."""
    seen = Observation()
    table = durable(df.observe(seen, F.count(F.lit(1)).alias("rows")), what)
    return table, seen.get["rows"]


class Growing:
    """A table that grows by one written part per wave and is read as one scan."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.folder, self.parts, self.schema = spark, fresh_path(spark, what), [], None

    def add(self, df: DataFrame) -> tuple[DataFrame, int]:
        """Write a part; returns it and how many rows it has, counted while writing."""
        path = f"{self.folder}/part-{len(self.parts):05d}"
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        self.schema = self.schema or df.schema
        self.parts.append(path)
        return self.spark.read.schema(self.schema).parquet(path), seen.get["rows"]

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.parts)
