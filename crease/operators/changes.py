"""Row mutations as ordered change sets: validated insert, update, delete.

A change is a step on its key's state, which is a row or absent; steps compose,
so a key's changes are folded in parts.  The changes are range-partitioned by
key and order, which spreads a hot key over partitions, and written once.
Whether a key is present after a part is told by the part's last valid insert
or delete, if it has one; these few rows, carried over the parts of a key, give
each part its state at the start, and a window inside the part gives every
change the state that it meets.  A key's row is then the latest value of every
column, an aggregate that combines map-side.

The table is asked once which changed keys it holds (a semi-join with the keys
of the changes, broadcast when they are few) and joined once with the folded
changes, so a small change set leaves it unshuffled.  The result is a new
DataFrame; write it to a new path and swap, never over the path being read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crease.functions.semantics import non_blank
from crease.sources.sinks import stage_lines

CHANGE_COLUMNS = ["op", "seq"]

# Display names used when listing players (fixed values).
PLAYER_DISPLAY_NAMES = {
    "player_id": "ID",
    "full_name": "Name",
    "country": "Team",
    "playing_role": "Role",
    "batting_style": "Batting Style",
    "bowling_style": "Bowling Style",
}


def _steps(base: DataFrame, changes: DataFrame, keys: list[str], required: Sequence[str]) -> DataFrame:
    """The changes in range partitions of (key, order), staged: `_part`, `_valid` (may insert) and `_order` added.

    Values have the table's types; columns that the changes lack are NULL, text of inserts is trimmed.
    """
    spark = base.sparkSession
    types = dict(base.dtypes)
    values = [c for c in base.columns if c not in keys]
    valid = F.lit(True)
    for k in keys:
        valid = valid & (F.coalesce(F.col(k) > 0, F.lit(False)) if types[k] in ("int", "bigint", "smallint")
                         else F.col(k).isNotNull())
    for c in required:
        valid = valid & non_blank(F.col(c))

    def value(c: str) -> Column:
        given = (F.col(c) if c in changes.columns else F.lit(None)).cast(types[c])
        return F.when(F.col("op") == "I", F.trim(given)).otherwise(given) if types[c] == "string" else given

    # equal numbers are ordered by the rest of the change
    order = ["seq", "op", *[c for c in values if c in changes.columns]]
    ranged = changes.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), *keys, *order)
    steps = ranged.select(*keys, "op", F.spark_partition_id().alias("_part"), valid.alias("_valid"),
                          F.struct(*order).alias("_order"), *[value(c).alias(c) for c in values])
    return stage_lines(steps, "changes")[0]


def fold_changes(base: DataFrame, changes: DataFrame, keys: Sequence[str],
                 required: Sequence[str] = ("full_name", "country")) -> tuple[DataFrame, DataFrame]:
    """Each change with the state that it meets, and each changed key with its outcome.

    The first frame has a row per change with `_before` (the key is present just
    before it).  The second has a row per key: `_was` (the table holds it),
    `_end` (present in the end), and per column a struct of the latest value
    set, NULL when the table's value stays.
    """
    keys = list(keys)
    values = [c for c in base.columns if c not in keys]
    steps = _steps(base, changes, keys, required)
    # a valid insert leaves the key present, a delete leaves it absent, whatever was before
    mark = F.when((F.col("op") == "I") & F.col("_valid"), True).when(F.col("op") == "D", False)
    steps = steps.withColumn("_mark", mark)
    last = F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col("_order")))
    parts = steps.groupBy("_part", *keys).agg(last.alias("_last"))
    held = base.select(*keys).join(parts.select(*keys).distinct(), keys, "left_semi").distinct()
    parts = parts.join(held.withColumn("_held", F.lit(True)), keys, "left")
    # one row per part of a key: bounded by the number of partitions
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_part", *keys, F.coalesce("_held", F.lit(False)).alias("_was"), F.coalesce(
        F.last("_last", ignorenulls=True).over(earlier), "_held", F.lit(False)).alias("_start"))
    inside = Window.partitionBy("_part", *keys).orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("_mark_before", F.last("_mark", ignorenulls=True).over(inside))
    same = reduce(Column.__and__, [steps[k].eqNullSafe(starts[k]) for k in ["_part", *keys]])
    told = steps.join(starts, same).select(
        *[steps[c] for c in steps.columns], "_was", F.coalesce("_mark_before", "_start").alias("_before"))

    born = (F.col("op") == "I") & F.col("_valid") & ~F.col("_before")
    patched = (F.col("op") == "U") & F.col("_before")
    folded = told.groupBy(*keys).agg(
        F.max("_was").alias("_was"), last.alias("_end"),
        *[F.max_by(F.struct(c), F.when(born | (patched & F.col(c).isNotNull()), F.col("_order"))).alias(f"_set_{c}")
          for c in values])
    return told, folded.withColumn("_end", F.coalesce("_end", "_was"))


def apply_changes(base: DataFrame, changes: DataFrame, keys: Sequence[str],
                  required: Sequence[str] = ("full_name", "country")) -> tuple[DataFrame, DataFrame]:
    """Apply a change set with columns op ('I' | 'U' | 'D'), seq, keys and values, one after the other.

    * changes of a key act in the order of `seq`, each on what the one before
      left (C5); equal `seq` are ordered by op and values;
    * 'I' inserts when the key is absent and the row is valid: text trimmed,
      `required` fields non-blank, numeric keys > 0, no NULL key (C4); an insert
      on a present key is rejected, as a primary-key violation would be;
    * 'U' overwrites the non-NULL values of a present row (C5);
    * 'D' removes a present row (C6);
    * updates and deletes of absent keys change nothing.

    Returns (table, rejected_inserts), the latter with a row per rejected change.
    """
    keys = list(keys)
    values = [c for c in base.columns if c not in keys]
    told, folded = fold_changes(base, changes, keys, required)

    def now(c: str, otherwise: Column) -> Column:
        return F.when(F.col(f"_set_{c}").isNotNull(), F.col(f"_set_{c}")[c]).otherwise(otherwise).alias(c)

    kept = base.join(folded, keys, "left").where(F.coalesce("_end", F.lit(True))) \
        .select(*keys, *[now(c, F.col(c)) for c in values])
    added = folded.where(~F.col("_was") & F.col("_end")).select(
        *keys, *[now(c, F.lit(None).cast(base.schema[c].dataType)) for c in values])
    rejected = told.where((F.col("op") == "I") & (F.col("_before") | ~F.col("_valid"))).select(
        *keys, "op", F.when(F.col("_before"), "duplicate key").otherwise("invalid row").alias("reason"))
    return kept.unionByName(added).select(*base.columns), rejected


def players_change_set(players: DataFrame) -> DataFrame:
    """A test change set derived from the players table (FIXTURES.md).

    Inserts copy ids ending in 0 under id + count(*), updates append '_U' to
    the country of ids ending in 1, deletes remove ids ending in 2; one
    update and one delete address ids that do not exist.
    """
    n = players.select(F.count(F.lit(1))).scalar()
    pid = F.col("player_id")
    cols = ["op", "seq", "player_id", "full_name", "country"]
    ins = players.where(pid % 10 == 0).select(F.lit("I").alias("op"), F.lit(1).cast("bigint").alias("seq"),
                                              (pid + n).alias("player_id"), "full_name", "country")
    upd = players.where(pid % 10 == 1).select(F.lit("U").alias("op"), F.lit(2).cast("bigint").alias("seq"),
                                              pid, F.lit(None).cast("string").alias("full_name"),
                                              F.concat(F.col("country"), F.lit("_U")).alias("country"))
    dele = players.where(pid % 10 == 2).select(F.lit("D").alias("op"), F.lit(3).cast("bigint").alias("seq"), pid,
                                               F.lit(None).cast("string").alias("full_name"),
                                               F.lit(None).cast("string").alias("country"))
    ghost = players.sparkSession.createDataFrame(
        [("U", 4, -1, None, "Nowhere"), ("D", 5, -2, None, None)],
        "op string, seq bigint, player_id bigint, full_name string, country string")
    return ins.select(*cols).unionByName(upd).unionByName(dele).unionByName(ghost)


def display_players(players: DataFrame) -> DataFrame:
    """The players table with display column names."""
    return players.withColumnsRenamed(PLAYER_DISPLAY_NAMES)
