"""Keys: dedupe, insert-if-absent, get-or-create ids, dimension stubs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crease.session import shared_folder


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def dedupe(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """Keep the first row per key, "first" meaning smallest `order_by`.

    Written as a `min_by` aggregation rather than `row_number() = 1`: the
    aggregate is combined map-side, so a key that holds a third of all rows
    is reduced per input partition before the shuffle, and no task ever
    holds a whole key group.  `order_by` should be unique within a key for a
    deterministic pick (add a tie-break column).
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    order = F.struct(*_cols(order_by))
    picked = (df.groupBy(*keys)
              .agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("_first")))
    return picked.select(*keys, *[F.col(f"_first.`{c}`").alias(c) for c in rest]).select(*df.columns)


def dedupe_all(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`dedupe` ordered by every non-key column: a deterministic pick whatever the input order.

    The smallest struct of the other columns is both order and payload, so
    they travel once.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    least = df.groupBy(*keys).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_first"))
    return least.select(*keys, *[F.col(f"_first.`{c}`").alias(c) for c in rest]).select(*df.columns)


def _same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """NULL-safe equality of the keys of two frames, the right one's named by `_keys_of`."""
    return reduce(Column.__and__, [left[k].eqNullSafe(right[f"_met_{k}"]) for k in keys])


def _keys_of(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_met_{k}") for k in keys])


def met_rows(stored: DataFrame, df: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Rows of `stored` whose key occurs in `df` (semi-join).

    The stored side streams: Spark broadcasts the keys of `df` when its size
    allows (staged or file-backed rows have a known size), so a small `df`
    leaves the stored table without exchange, and a partition column among the
    keys prunes the scan.  Beyond that size both sides are shuffled.
    """
    keys = list(keys)
    if not null_safe:
        return stored.join(df.select(*keys).distinct(), keys, "left_semi")
    wanted = _keys_of(df, keys).distinct()
    return stored.join(wanted, _same_key(stored, wanted, keys), "left_semi")


def new_rows(df: DataFrame, existing: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """I8 / U4: rows of `df` whose key is not in `existing`.

    The stored keys are first reduced to those that occur in `df`
    (`met_rows`); the anti-join then meets no more keys than `df` has, never
    the whole stored table.  `null_safe=True` treats NULL keys as equal (the
    source's pandas merge pairs NaN with NaN on composite keys).  Only the key
    columns of the stored table are read; each row of `df` is returned at most
    once.
    """
    keys = list(keys)
    met = met_rows(existing.select(*keys), df, keys, null_safe)
    if not null_safe:
        return df.join(met, keys, "left_anti")
    met = _keys_of(met, keys)
    return df.join(met, _same_key(df, met, keys), "left_anti")


def other_rows(df: DataFrame, existing: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """`new_rows` for a `df` as large as the stored table: both sides are read and exchanged once, none is reduced first."""
    keys = list(keys)
    if not null_safe:
        return df.join(existing.select(*keys), keys, "left_anti")
    there = _keys_of(existing, keys)
    return df.join(there, _same_key(df, there, keys), "left_anti")


def fresh_rows(df: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`dedupe_all`, then `new_rows` (NULL-safe), with one exchange of the rows and one of the stored keys.

    Rows and stored keys meet in one grouping by key, which pairs NULL keys
    with each other as it is; `df` is read once.  For a load that is small
    beside the stored table, reduce `existing` by `met_rows` first.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    rows = df.select(*keys, F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_first"), F.lit(False).alias("_there"))
    there = existing.select(*keys, F.lit(None).cast(rows.schema["_first"].dataType).alias("_first"), F.lit(True).alias("_there"))
    least = rows.unionByName(there).groupBy(*keys).agg(F.min("_first").alias("_first"), F.max("_there").alias("_there"))
    return least.where(~F.col("_there")).select(
        *keys, *[F.col(f"_first.`{c}`").alias(c) for c in rest]).select(*df.columns)


def consecutive_ids(df: DataFrame, order_by: Sequence[str], start: Column | int = 1,
                    id_col: str = "id", num_partitions: int | None = None) -> DataFrame:
    """Number rows start, start+1, ... in `order_by` order, without a global window.

    The range-partitioned rows are written once, with their partition number,
    to the shared scratch folder: both the rows per partition (one small row
    each, turned into offsets) and the numbering read the same files, so the
    two cannot disagree about the partitions' borders.  `order_by` must be
    unique for repeatable ids.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    path = shared_folder(spark, "numbering")
    ranged = df.repartitionByRange(n, *order_by).withColumn("_pid", F.spark_partition_id())
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # running total over the per-partition counts: this window sees one row per
    # partition (bounded by the partition count), never the data rows
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    in_part = F.row_number().over(Window.partitionBy("_pid").orderBy(*order_by))
    start_c = start if isinstance(start, Column) else F.lit(start)
    # the offsets frame has one row per partition: a bounded broadcast
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(id_col, (start_c + F.coalesce(F.col("_off"), F.lit(0)) + in_part - 1).cast("bigint"))
            .drop("_pid", "_off"))


def assign_keys(names: DataFrame, dim: DataFrame, name_col: str, id_col: str,
                defaults: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Get-or-create dimension ids for a column of names.

    Returns (lookup, new_members): `lookup` maps every distinct name to its id
    (existing or new); `new_members` are the dimension rows to append, ids
    continuing from max(id) + 1 (from 1 on an empty dimension), numbered in
    name order so a rerun over the same input assigns the same ids.
    """
    wanted = names.select(F.col(name_col)).where(F.col(name_col).isNotNull()).distinct()
    known = met_rows(dim.select(name_col, id_col), wanted, [name_col])
    # an existing name keeps its smallest id
    known = known.groupBy(name_col).agg(F.min(id_col).alias(id_col))
    missing = wanted.join(known, name_col, "left_anti")
    # max(id) + 1 as a scalar subquery: evaluated once, no driver round trip
    first_id = dim.select(F.coalesce(F.max(id_col), F.lit(0)) + 1).scalar()
    fresh = consecutive_ids(missing, [name_col], start=first_id, id_col=id_col) \
        .select(F.col(name_col), F.col(id_col))
    extra = [F.lit(v).alias(k) for k, v in (defaults or {}).items()]
    new_members = fresh.select(F.col(id_col), F.col(name_col), *extra)
    lookup = known.unionByName(fresh)
    return lookup, new_members


def ensure_members(facts: DataFrame, dim: DataFrame, id_col: str, name_col: str | None = None,
                   dim_name_col: str | None = None, defaults: dict | None = None) -> DataFrame:
    """Dimension stubs for ids the facts reference but the dimension lacks.

    One stub per missing id; its name is the smallest name the facts carry
    for it, other columns take `defaults` (the source uses 'Unknown').
    """
    if name_col:
        ids = facts.where(F.col(id_col).isNotNull()).groupBy(id_col) \
            .agg(F.min(name_col).alias(dim_name_col or name_col))
    else:
        ids = facts.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    # the ids may cost a whole pass over documents: they are read once, so the dimension is not reduced by them first
    missing = other_rows(ids, dim, [id_col])
    extra = [F.lit(v).alias(k) for k, v in (defaults or {}).items()]
    return missing.select("*", *extra)
