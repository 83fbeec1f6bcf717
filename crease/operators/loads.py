"""End-to-end ingest workflows over a folder of stored tables.

Each `load_*` takes parsed documents, turns them into rows of one or more
target tables, keeps only rows whose key is not stored yet (I8), appends
them (R6-R8) and returns load reports (R10).  Lines with unreadable numbers are
kept under `_rejects` (`sinks.keep_rejects`).  Every workflow is idempotent:
running it again on the same documents adds nothing, so a rerun after a
failure is safe.  Tables that do not exist yet are treated as empty.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.operators import ingest as I
from crease.operators.keys import consecutive_ids, fresh_rows, met_rows, new_rows
from crease.session import delete_folder, is_small, shared_folder
from crease.sources.schemas import table_schema
from crease.sources.sinks import LoadReport, append_rows, conform, faulty_lines, keep_rejects, stage_lines
from crease.sources.tables import load_table, path_exists

PLAYER_LIST_KEYS = ("player", "players", "rank", "values")


def stored(spark: SparkSession, base_dir: str, table: str) -> DataFrame:
    """The stored table, or an empty frame with its schema when it does not exist yet."""
    if path_exists(spark, os.path.join(base_dir, table)):
        return load_table(spark, base_dir, table)
    return spark.createDataFrame([], table_schema(table))


def _append_new(df: DataFrame, base_dir: str, table: str, keys: list[str], null_safe: bool = False) -> LoadReport:
    """Append the rows with new keys; `df` is staged once, so its keys have a known size."""
    spark = df.sparkSession
    rows, path, _ = stage_lines(df, table)
    report = append_rows(new_rows(rows, stored(spark, base_dir, table), keys, null_safe=null_safe), base_dir, table)
    delete_folder(spark, path)
    return report


def load_players(docs: DataFrame, base_dir: str, country: str = I.UNKNOWN) -> LoadReport:
    """Player lists under any of four keys -> new players."""
    players = I.extract_players(I.collect_entries(docs, PLAYER_LIST_KEYS), country)
    return _append_new(players, base_dir, "players", ["player_id"])


def load_teams(docs: DataFrame, base_dir: str) -> LoadReport:
    """Team lists -> new teams."""
    return _append_new(I.extract_teams(docs), base_dir, "teams", ["team_id"])


def load_venues(series_docs: DataFrame | None, match_docs: DataFrame | None, base_dir: str) -> LoadReport:
    """Series venue lists and flat match lists -> new venues with assigned ids.

    A venue is new when its (name, city, country) is not stored (NULL-safe,
    as the source's merge); ids continue from the stored maximum (I9).
    """
    spark = (series_docs or match_docs).sparkSession
    venues = I.extract_venues(series_docs, match_docs)
    current = stored(spark, base_dir, "venues")
    fresh = new_rows(venues, current, ["venue_name", "city", "country"], null_safe=True)
    first_id = current.select(F.coalesce(F.max("venue_id"), F.lit(0)) + 1).scalar()
    rows = consecutive_ids(fresh, ["venue_name", "city", "country"], start=first_id, id_col="venue_id")
    return append_rows(rows, base_dir, "venues")


def load_matches(docs: DataFrame, base_dir: str, stage_dir: str | None = None) -> list[LoadReport]:
    """Wrapped match lists -> new matches, plus teams and venues created on the way.

    The flattened rows are staged once (by default in the shared scratch
    folder, which is deleted afterwards) so the key-numbering passes read
    compact Parquet instead of re-parsing the documents.
    """
    spark = docs.sparkSession
    scratch = stage_dir or shared_folder(spark, "matches")
    out = I.extract_matches(docs, stored(spark, base_dir, "teams"), stored(spark, base_dir, "venues"),
                            existing=stored(spark, base_dir, "matches"), stage_dir=scratch)
    reports = [append_rows(out["new_teams"], base_dir, "teams"),
               append_rows(out["new_venues"], base_dir, "venues"),
               append_rows(out["matches"], base_dir, "matches")]
    if stage_dir is None:
        delete_folder(spark, scratch)
    return reports


def _with_player_stubs(lines: DataFrame, base_dir: str) -> LoadReport:
    stubs = I.stub_players(lines, stored(lines.sparkSession, base_dir, "players"))
    return append_rows(stubs, base_dir, "players")


def _load_lines(lines: DataFrame, base_dir: str, table: str, keys: list[str]) -> list[LoadReport]:
    """Scorecard lines -> stub players, then new lines by natural key (NULL-safe); the id is a hash of the key.

    The documents are parsed once, into staged lines.
    """
    staged, path, bad = stage_lines(lines, table, I.FAULT)
    good = staged.where(F.col(I.FAULT) == "").drop(I.FAULT)
    there = stored(lines.sparkSession, base_dir, table).select(*keys)
    if is_small(staged):
        there = met_rows(there, good, keys, null_safe=True)
    fresh = fresh_rows(good, there, keys).withColumn("stat_id", I.stat_id(*keys))
    reports = [_with_player_stubs(good, base_dir), append_rows(fresh, base_dir, table, rejected=bad)]
    if bad:
        keep_rejects(faulty_lines(staged, I.FAULT), base_dir, table)
    delete_folder(lines.sparkSession, path)
    return reports


def load_batting(docs: DataFrame, base_dir: str, fmt: str = I.DEFAULT_FORMAT) -> list[LoadReport]:
    """Innings scorecards -> batting lines, with stub players for unknown ids."""
    return _load_lines(I.extract_batting(docs, fmt, with_faults=True), base_dir, "batting_stats",
                       ["match_id", "format", "innings_number", "batting_position", "player_id"])


def load_bowling(docs: DataFrame, base_dir: str, fmt: str = I.DEFAULT_FORMAT) -> list[LoadReport]:
    """Innings scorecards -> bowling lines, with stub players for unknown ids."""
    return _load_lines(I.extract_bowling(docs, fmt, with_faults=True), base_dir, "bowling_stats",
                       ["match_id", "format", "innings_number", "line_number", "player_id"])


def load_player_match(docs: DataFrame, base_dir: str) -> LoadReport:
    """Per-player match lists -> player_match rows.

    The table declares no key and the source inserts every entry, so equal
    rows are kept: as many of each are appended as the documents have more of
    them than the stored table.  A strike rate that does not fit its column is
    rejected, as the source database rejects the insert.
    """
    lines = I.extract_player_match(docs, with_faults=True)
    fits = F.coalesce(F.abs("strike_rate") < 1000, F.lit(True))  # DECIMAL(5,2)
    lines = lines.withColumn(I.FAULT, F.when(fits, F.col(I.FAULT)).otherwise(F.concat_ws(
        ",", F.nullif(F.col(I.FAULT), F.lit("")), F.lit("strike_rate"))))
    staged, path, bad = stage_lines(lines, "player_match", I.FAULT)
    rows = conform(staged.where(F.col(I.FAULT) == "").drop(I.FAULT), "player_match")
    # an equal row has an equal date: only the stored rows of the load's dates are compared
    there = met_rows(stored(docs.sparkSession, base_dir, "player_match"), rows, ["match_date"], null_safe=True)
    fresh = rows.exceptAll(there)
    report = append_rows(fresh, base_dir, "player_match", rejected=bad)
    if bad:
        keep_rejects(faulty_lines(staged, I.FAULT), base_dir, "player_match")
    delete_folder(docs.sparkSession, path)
    return report
