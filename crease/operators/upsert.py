"""Upsert of stored tables by replacing only the partitions that change.

An upserted table is stored in folders by a hash of (some of) its key columns,
`key_part_<n>=<k>` with n parts; the number of parts is read back from the
folder's name, so a later load cannot disagree with it.  An upsert compares the
new rows with the stored rows of the parts that they fall into, and rewrites
the parts in which a row is new or differs; all other parts keep their files.

The merged parts are written beside the stored ones and replace them when all
are written (dynamic partition overwrite), so no file is read while it is
replaced, and an upsert that fails on the way can be run again.  Choose
the number of parts so that one part is a file of some 100 MB; keys are unique,
so no part can be hot.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crease.operators.keys import new_rows
from crease.session import delete_folder, is_small
from crease.sources.schemas import TABLE_DDL
from crease.sources.sinks import CODEC, LoadReport, conform, replace_table, stage_lines
from crease.sources.tables import path_exists

PREFIX = "key_part_"
DEFAULT_PARTS = 64


def part_of(keys: Sequence[str], parts: int) -> Column:
    """The part of a row: a hash of its key columns, NULLs included."""
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(parts)).cast("int")


def in_parts(df: DataFrame, part_keys: Sequence[str], parts: int = DEFAULT_PARTS) -> DataFrame:
    """`df` with the rows of a part together, and their part as column `_part`."""
    return df.withColumn("_part", part_of(part_keys, parts)).repartition("_part")


def _laid_out(spark: SparkSession, schema: StructType, part_keys: Sequence[str], parts: int, base_dir: str,
              table: str) -> tuple[DataFrame | None, str]:
    """The stored table (None if it has no rows) and its part column.

    A table stored in another layout is rewritten into parts once.
    """
    path, column = os.path.join(base_dir, table), f"{PREFIX}{parts}"
    if not path_exists(spark, path):
        return None, column
    df = spark.read.schema(schema).parquet(path)
    found = [c for c in df.columns if c.startswith(PREFIX)]
    if found:
        return df, found[0]
    if not df.limit(1).count():
        delete_folder(spark, path)
        return None, column
    replace_table(df.withColumn(column, part_of(part_keys, parts)), base_dir, table, partition_by=[column])
    return spark.read.schema(schema).parquet(path), column


def upsert_rows(df: DataFrame, base_dir: str, table: str, keys: Sequence[str], part_keys: Sequence[str] | None = None,
                parts: int = DEFAULT_PARTS, rejected: int = 0, staged: bool = False,
                arranged: bool = False) -> LoadReport:
    """Store `df`, which has one row per key: rows of stored keys are replaced, others inserted (last wins).

    NULL keys are equal to each other.  `part_keys` (a subset of the keys,
    default all of them) choose a row's part.  The report counts inserted and
    updated rows; stored rows that are given again unchanged are skipped and
    touch nothing.  `staged=True`: `df` is read from files that do not change, and need not be staged.
    `arranged=True`: its rows lie by part already (`in_parts` of the same keys
    and number of parts), so that a first load writes them where they are.
    """
    spark, keys = df.sparkSession, list(keys)
    part_keys = list(part_keys or keys)
    path = os.path.join(base_dir, table)
    rows = conform(df, table) if table in TABLE_DDL else df
    if not path_exists(spark, path):
        return LoadReport(table, _store_first(rows, path, part_keys, f"{PREFIX}{parts}", arranged), rejected=rejected)
    given, given_path = rows, None
    if not staged:  # before the stored table, which it may read, changes
        given, given_path, _ = stage_lines(rows, f"{table}-given")
    stored, column = _laid_out(spark, rows.schema, part_keys, parts, base_dir, table)
    if stored is None:
        total = _store_first(given, path, part_keys, column)
        if given_path:
            delete_folder(spark, given_path)
        return LoadReport(table, total, rejected=rejected)
    given = given.withColumn(column, part_of(part_keys, int(column.removeprefix(PREFIX))))
    # the parts are at most so many as the layout has: a bounded list on the driver
    here = [r[0] for r in given.select(column).distinct().collect()]
    near = stored.where(F.col(column).isin(here)).select(*given.columns)
    # a small load finds its stored rows by broadcast; of a large one both sides travel once, by part as they are stored
    differ = new_rows(given, near, given.columns, null_safe=True) if is_small(given) else _unlike(given, near, column)
    changed, changed_path, _ = stage_lines(differ, f"{table}-changed")
    touched = [r[0] for r in changed.select(column).distinct().collect()]
    updated, total, total_given = 0, changed.count(), given.count()
    if touched:
        # stored and changed rows of a part meet in one exchange; a stored row whose key has changed gives way
        old = stored.where(F.col(column).isin(touched)).select(*given.columns)
        both = old.withColumn("_new", F.lit(0)).unionByName(changed.withColumn("_new", F.lit(1))).repartition(column)
        last = F.max("_new").over(Window.partitionBy(column, *keys))
        merged = both.withColumn("_last", last).where(F.col("_new") == F.col("_last")).drop("_new", "_last")
        before = old.count()
        # new files are moved into place when all tasks have read and written theirs
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", CODEC) \
            .partitionBy(column).parquet(path)
        now = spark.read.schema(given.schema).parquet(path).where(F.col(column).isin(touched))
        updated = before + total - now.count()
    for scratch in filter(None, (given_path, changed_path)):
        delete_folder(spark, scratch)
    return LoadReport(table, total - updated, skipped=total_given - total, rejected=rejected, updated=updated)


def _unlike(given: DataFrame, stored: DataFrame, column: str) -> DataFrame:
    """Rows of `given` (distinct) that `stored` has not just so; NULLs are equal to each other."""
    both = stored.withColumn("_new", F.lit(False)).unionByName(given.withColumn("_new", F.lit(True)))
    # rows of a file share its part: they stay beside each other in the exchange, and so travel in few bytes
    return both.repartition(column).groupBy(*given.columns).agg(F.min("_new").alias("_new")).where("_new").drop("_new")


def _store_first(rows: DataFrame, path: str, part_keys: Sequence[str], column: str,
                 arranged: bool = False) -> int:
    """Store the first rows of a table in their parts, in one pass; return their number."""
    rows = rows.withColumn(column, part_of(part_keys, int(column.removeprefix(PREFIX))))
    (rows if arranged else rows.repartition(column)).write.mode("append").option("compression", CODEC) \
        .partitionBy(column).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).count()


def read_upserted(spark: SparkSession, base_dir: str, table: str) -> DataFrame:
    """A table stored by `upsert_rows`, without the column of its layout."""
    df = spark.read.parquet(os.path.join(base_dir, table))
    return df.drop(*[c for c in df.columns if c.startswith(PREFIX)])
