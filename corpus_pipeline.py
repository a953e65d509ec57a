"""The corpus pipeline: language, quality, near-duplicates, benchmark leaks, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weblode.llm import stages
from weblode.llm.common import table, written

#: Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("language", stages.language),
    ("quality", stages.quality),
    ("near_duplicates", stages.near_duplicates),
    ("benchmark_leaks", stages.benchmark_leaks),
    ("tokens", stages.tokens),
]

#: Trained models and token ids are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
