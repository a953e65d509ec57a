"""Where tables go: JSON, CSV, a page per file name, the corpus and its index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weblode.functions import urls
from weblode.functions.headers import file_extension
from weblode.operators.corpus import compact, csv_ready, index_line


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; list cells joined by ``; ``."""
    csv_ready(rows).write.mode("overwrite").option("header", True).csv(path)


def file_name(number: Column, url: Column, extension: str | Column) -> Column:
    """``001-host-path.md``"""
    ext = F.lit(extension) if isinstance(extension, str) else extension
    return F.concat(F.lpad(number.cast("string"), F.greatest(F.lit(3), F.length(number.cast("string"))), F.lit("0")), F.lit("-"), urls.slug(url, 60), F.lit("."), ext)


def write_pages(pages: DataFrame, path: str, number: str, body: str = "markdown") -> None:
    """One row per page with the name its file would have, split by host."""
    named = pages.select(urls.host("url").alias("host"), file_name(F.col(number), F.col("url"), "md").alias("file_name"), "url", F.col(body).alias("body"))
    named.write.mode("overwrite").partitionBy("host").parquet(path)


def write_binaries(bodies: DataFrame, path: str, number: str, media: str = "media") -> None:
    """Non-text bodies with the extension their type asks for."""
    ext = file_extension(F.col(media))
    bodies.select(file_name(F.col(number), F.col("url"), ext).alias("file_name"), "url", media, "body").write.mode("overwrite").parquet(path)


def append_corpus(records: DataFrame, path: str) -> None:
    records.select("seq", "url", "title", "markdown").write.mode("append").parquet(path)


def compact_corpus(spark, path: str, out: str) -> DataFrame:
    """Rewrite a corpus with the last record of each URL; the input stays untouched."""
    last = compact(spark.read.parquet(path), "url", "seq")
    last.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def write_index(corpus: DataFrame, path: str) -> None:
    lines = corpus.select("first_seen", index_line(F.col("title"), F.col("url"), F.coalesce("markdown", F.lit(""))).alias("value"))
    lines.orderBy("first_seen").select("value").write.mode("overwrite").text(path)
