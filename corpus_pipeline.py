"""Training-corpus pipeline: quality filter, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  The first three drop rows and return the columns of ``documents``; the
last returns a row per packed piece.  :func:`run` writes each stage's rows as
Parquet to shared storage, and the next stage reads them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crease.llm import decontaminate, packing, quality, queries, simhash
from crease.llm.common import ship, stage


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    ship(spark)
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id."""
    ship(spark)
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    ship(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences."""
    ship(spark)
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [("quality_filter", quality_filter), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("pack", pack)]

#: SQL cannot express the fitted classifier or the packing; tests/llm has a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage_of in STAGES:
        docs, _ = stage(stage_of(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
