"""Substring search by a trigram index.

The index is a table (trigram, player_id) of the distinct character trigrams of
the lower-case names, stored in ranges of trigrams, so a search reads the row
groups of its own few trigrams.  A name holds the needle only if it has all of
the needle's trigrams: players are the candidates that have each of them, and
the plain test decides.  Needles of fewer than three characters have no trigram
and take the plain scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crease.operators.products import player_search


def name_trigrams(players: DataFrame, name_col: str = "full_name") -> DataFrame:
    """(trigram, player_id), distinct; names of fewer than three characters have none."""
    name = players.select("player_id", F.lower(F.col(name_col)).alias("name")).where(F.length("name") >= 3)
    # a player's names (mostly one) meet before they are cut: no task holds a table of the far more numerous trigrams
    names = name.groupBy("player_id").agg(F.collect_set("name").alias("names"))

    def cut(n):
        return F.transform(F.sequence(F.lit(1), F.length(n) - 2), lambda i: F.substring(n, i, F.lit(3)))

    grams = F.array_distinct(F.flatten(F.transform("names", cut)))
    return names.select(F.explode(grams).alias("trigram"), "player_id")


def write_name_index(players: DataFrame, path: str, name_col: str = "full_name") -> None:
    """Store the index in ranges of (trigram, player_id); a frequent trigram is spread over several files."""
    name_trigrams(players, name_col).repartitionByRange("trigram", "player_id") \
        .sortWithinPartitions("trigram", "player_id").write.mode("overwrite").parquet(path)


def indexed_search(players: DataFrame, index: DataFrame, text: str, name_col: str = "full_name",
                   team_col: str = "country") -> DataFrame:
    """The rows of `player_search`, by the index."""
    needle = text.lower()
    grams = sorted({needle[i:i + 3] for i in range(len(needle) - 2)})
    if not grams:
        return player_search(players, text, name_col, team_col)
    found = index.where(F.col("trigram").isin(grams)).groupBy("player_id").agg(F.count("*").alias("n"))
    candidates = found.where(F.col("n") == len(grams)).select("player_id")
    return player_search(players.join(candidates, "player_id", "left_semi"), text, name_col, team_col)
