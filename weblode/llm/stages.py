"""The stages of the corpus pipeline.  Each takes (spark, docs, sf_dir); all but the last return the columns of ``docs``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weblode.llm import bpe, decontam, langid, linecrf, neardup
from weblode.llm.common import table, written

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language is ``und`` or less than half sure."""
    return langid.kept(docs, langid.trained(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that the quality field scores under 0.7."""
    return linecrf.kept(docs, linecrf.trained(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; of repeated rows, one."""
    return neardup.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a passage of a benchmark item."""
    found = decontam.leaks(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(written(found.select("doc_id").distinct(), "leaked"), "doc_id", "left_anti").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, with the digests of ids and of the decoded bytes."""
    return bpe.digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True)
