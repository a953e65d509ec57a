"""Sitemap files, gzip or plain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_url, body): one row per file; Spark unpacks ``.gz`` by name."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_url"), F.col("value").alias("body"))
