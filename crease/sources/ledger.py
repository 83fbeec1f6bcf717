"""Ledger of loaded files (R3): a batch load skips the files that it has loaded already.

The ledger is a small table beside the stored ones, `_loaded_files`, with kind,
path, modification time and length.  A file that has changed since counts as
new.  Files are listed by their metadata only; a file that the ledger has is
never opened.  The ledger is written after the load has stored its rows: a load
that fails on the way is simply run again, which adds nothing twice.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.operators.keys import new_rows
from crease.sources.tables import path_exists

LEDGER = "_loaded_files"
SCHEMA = "kind string, path string, modified timestamp, length bigint"


def list_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The files of a file, folder or glob, without opening them."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.lit(kind).alias("kind"), "path", F.col("modificationTime").alias("modified"), "length")


def new_files(spark: SparkSession, path: str, kind: str, base_dir: str) -> DataFrame:
    """The files of `path` that no earlier load of this kind has stored."""
    files = list_files(spark, path, kind)
    ledger = os.path.join(base_dir, LEDGER)
    if not path_exists(spark, ledger):
        return files
    return new_rows(files, spark.read.schema(SCHEMA).parquet(ledger), files.columns)


def mark_loaded(files: DataFrame, base_dir: str) -> None:
    files.write.mode("append").parquet(os.path.join(base_dir, LEDGER))
