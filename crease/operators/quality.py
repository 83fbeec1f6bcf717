"""Constraint checks the storage layer does not enforce.

Each check is one distributed aggregation or anti-join and returns the
violations as a DataFrame; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, or contain a NULL, with their row count.

    The count is a partial (map-side) aggregate, so a key repeated millions
    of times is reduced before the shuffle.
    """
    keys = list(keys)
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
            .where((F.col("row_count") > 1) | any_null))


def check_reference(df: DataFrame, col: str, dim: DataFrame, key: str) -> DataFrame:
    """Rows whose `col` has no match in `dim.key`; NULL references pass (SQL FK rule)."""
    keys = dim.select(F.col(key).alias("_ref_key")).distinct()
    return df.where(F.col(col).isNotNull()).join(keys, F.col(col) == F.col("_ref_key"), "left_anti")


def reference_report(tables: Mapping[str, DataFrame],
                     foreign_keys: Mapping[str, Sequence[tuple[str, str, str]]]) -> DataFrame:
    """C2 for a whole schema: one row per declared foreign key with its orphan count."""
    parts = []
    for table, fks in foreign_keys.items():
        for col, dim, key in fks:
            orphans = check_reference(tables[table].select(col), col, tables[dim], key)
            parts.append(orphans.agg(F.count(F.lit(1)).alias("orphan_rows"))
                         .select(F.lit(table).alias("table_name"), F.lit(col).alias("column_name"),
                                 F.lit(dim).alias("ref_table"), "orphan_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check_types(df: DataFrame, table: str, widths: Mapping[str, int]) -> DataFrame:
    """Per declared VARCHAR(n) column, the number of values longer than n.

    One pass over the table computes every column's counts; the result is
    reshaped to one row per column.
    """
    aggs = []
    for c, w in widths.items():
        aggs.append(F.struct(F.lit(c).alias("column_name"), F.lit(w).cast("bigint").alias("max_width"),
                             F.sum(F.when(F.length(c) > w, 1).otherwise(0)).cast("bigint").alias("violations"),
                             F.max(F.length(c)).cast("bigint").alias("longest")))
    return df.agg(F.array(*aggs).alias("r")).select(F.inline("r"))


def check_castable(df: DataFrame, col: str, type_name: str) -> DataFrame:
    """C3 for text that must parse as `type_name`: the rows where try_cast fails."""
    return df.where(F.col(col).isNotNull() & F.col(col).try_cast(type_name).isNull())
