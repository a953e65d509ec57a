"""Stored responses as the common input table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

HTML = "text/html; charset=utf-8"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def pages(spark: SparkSession, root: str) -> DataFrame:
    """A (page_id, url, html) table lifted to usable responses.

    A stored table may come in a few large files; where there are fewer input
    splits than cores, rows are spread once so that all cores tokenise.
    """
    return lift(spread(table(spark, root, "pages")))


def spread(df: DataFrame) -> DataFrame:
    """Spread rows over the cores when the scan has fewer splits than there are cores.

    A large table has more splits than cores and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Deal small rows that make much work (a page built out of a few columns) over all cores, whatever the size and row groups of their files."""
    spark = df.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


def lift(df: DataFrame) -> DataFrame:
    """Add what a stored HTML answer implies: status 200, HTML type, same final URL."""
    return df.select(
        "page_id", "url", F.col("url").alias("requested_url"), F.lit(200).alias("status"),
        F.create_map(F.lit("Content-Type"), F.lit(HTML)).alias("headers"), "html",
    )


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored body: path as url, bytes, length, time of storage."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.col("path").alias("url"), F.col("content").alias("body"), "length", F.col("modificationTime").alias("stored_at")
    )


def url_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """Whitespace-separated URLs to (url, pos), normalised, first occurrence kept.

    ``pos`` orders like the text: ``line`` (when the input has it) then word.
    """
    from weblode.functions.urls import normalize

    line = F.col("line") if "line" in lines.columns else F.lit(0)
    words = lines.select(line.alias("line"), F.posexplode(F.split(F.trim(column), r"\s+")).alias("word", "raw"))
    good = words.filter(F.col("raw") != "").withColumn("url", normalize("raw")).filter(F.col("url").isNotNull())
    return good.groupBy("url").agg(F.min(F.struct("line", "word")).alias("pos"))


def json_lines(lines: DataFrame, schema: str, required: str, column: str = "line") -> DataFrame:
    """JSON-lines records; malformed lines and lines without the required key are skipped."""
    parsed = lines.withColumn("_r", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    kept = parsed.filter(F.try_parse_json(column).isNotNull() & F.col("_r").isNotNull() & F.col(f"_r.{required}").isNotNull())
    return kept.select(*[c for c in lines.columns if c != column], "_r.*")


def csv_feed(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV feed with a header, all cells as texts; the columns asked for by name, whatever order a file has them in, missing ones null."""
    found = spark.read.option("header", True).option("enforceSchema", False).option("multiLine", True).csv(path)
    return found.select(*[F.col(f"`{c}`") if c in found.columns else F.lit(None).cast("string").alias(c) for c in columns])
