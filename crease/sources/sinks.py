"""Append sink with an insert-if-absent guard and a load report."""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from crease.session import shared_folder
from crease.sources.schemas import TABLE_DDL, table_schema


#: of stored tables and staged rows, which a load writes once and reads at most a few times
CODEC = "zstd"


@dataclass
class LoadReport:
    table: str
    inserted: int
    skipped: int = 0
    rejected: int = 0
    updated: int = 0


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select and cast the target table's columns in declared order (missing -> NULL).

    Casts are strict under ANSI mode: a value that does not fit the declared
    type (e.g. a rate above 999.99 for DECIMAL(5,2)) fails the write, as the
    source database's strict mode rejects the insert, instead of being
    silently replaced by NULL.
    """
    schema = table_schema(table)
    cols = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def append_rows(df: DataFrame, base_dir: str, table: str, skipped: int = 0, rejected: int = 0,
                partition_by: list[str] | None = None) -> LoadReport:
    """One distributed append of `df` to `<base_dir>/<table>`, in one pass.

    R8: an empty `df` adds no rows.  R10: the inserted row count is gathered by
    an `Observation` during the write itself, not by a second pass.
    """
    out = conform(df, table) if table in TABLE_DDL else df
    obs = Observation(f"append_{table}")
    w = out.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("append").option("compression", CODEC)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(os.path.join(base_dir, table))
    return LoadReport(table, int(obs.get.get("rows", 0)), skipped, rejected)


REJECTS = "_rejects"


def rejects_path(base_dir: str, table: str) -> str:
    return os.path.join(base_dir, REJECTS, table)


def keep_rejects(rejected: DataFrame, base_dir: str, table: str) -> None:
    """Add rejected input to `<base_dir>/_rejects/<table>`, once.

    Rows have a reason, the file and block they come from (NULL for lines,
    whose documents were good), and the raw text.  What is there already is not
    added again, so a load that is run twice leaves one copy.
    """
    spark, path = rejected.sparkSession, rejects_path(base_dir, table)
    rows = rejected.select(*[(F.col(c) if c in rejected.columns else F.lit(None)).cast(t).alias(c) for c, t in (
        ("reason", "string"), ("file", "string"), ("block", "bigint"), ("raw", "string"))])
    fs, folder = _fs(spark, path)
    if fs.exists(folder):
        there = spark.read.schema(rows.schema).parquet(path)
        same = reduce(Column.__and__, [rows[c].eqNullSafe(there[c]) for c in rows.columns])
        rows = rows.join(there, same, "left_anti")
    rows.write.mode("append").parquet(path)


def faulty_lines(lines: DataFrame, fault: str) -> DataFrame:
    """Lines with a fault as rejects: the unreadable fields are the reason, the line's JSON the raw text."""
    rest = [c for c in lines.columns if c != fault]
    return lines.where(F.col(fault) != "").select(F.col(fault).alias("reason"),
                                                  F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("raw"))


def stage_lines(df: DataFrame, name: str, fault: str | None = None) -> tuple[DataFrame, str, int]:
    """Write `df` once to the shared scratch folder; return it read back, its folder, and its faulty rows.

    Rows whose `fault` text is not empty are counted while they are written.
    """
    path = shared_folder(df.sparkSession, name)
    obs = Observation(f"stage_{name}")
    bad = F.count(F.when(F.col(fault) != "", 1)) if fault else F.count(F.lit(None))
    df.observe(obs, bad.alias("bad")).write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path, int(obs.get.get("bad", 0))


def _fs(spark, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def replace_table(df: DataFrame, base_dir: str, table: str, partition_by: list[str] | None = None) -> str:
    """Rewrite a stored table with `df`, which may itself read that table.

    The new version is written next to the table first; only after the write
    has finished are the folders swapped (current -> `.<table>-previous-<id>`,
    new -> current), so the path being read is never overwritten and a
    failure before the swap leaves the current version untouched.  Returns
    the folder holding the previous version (kept; the caller decides when
    to drop it).
    """
    import uuid

    spark = df.sparkSession
    tag = uuid.uuid4().hex[:12]
    target = os.path.join(base_dir, table)
    staged = os.path.join(base_dir, f".{table}-new-{tag}")
    previous = os.path.join(base_dir, f".{table}-previous-{tag}")
    out = conform(df, table) if table in TABLE_DDL and not partition_by else df
    out.write.mode("errorifexists").partitionBy(*(partition_by or [])).parquet(staged)
    fs, cur = _fs(spark, target)
    jvm = spark.sparkContext._jvm
    if fs.exists(cur) and not fs.rename(cur, jvm.org.apache.hadoop.fs.Path(previous)):
        raise OSError(f"could not move {target} aside")
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(staged), cur):
        raise OSError(f"could not move {staged} into place (previous version at {previous})")
    return previous
