"""Registered queries for the ingest, constraint and change-set operators.

Each query derives its input from the test tables (documents are nested from
the derived tables by Spark, see `nesting`), runs the operator over all of
it, and has an oracle: plain SQL that computes the expected flat rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.operators import ingest as I
from crease.operators.changes import apply_changes, display_players, players_change_set
from crease.operators.keys import assign_keys, dedupe, new_rows
from crease.operators.quality import check_types, check_unique, reference_report
from crease.plans import nesting as N
from crease.plans.oracle_sql import r2, with_tables
from crease.plans.registry import normalize_types
from crease.sources.documents import parse_documents
from crease.sources.fixtures import fixture_tables
from crease.sources.schemas import FOREIGN_KEYS, VARCHAR_WIDTHS, doc_schema


def _docs(df: DataFrame, schema_name: str) -> DataFrame:
    good, _rejected = parse_documents(df, "value", doc_schema(schema_name))
    return good


# ---------------------------------------------------------------------------
# ingest round trips
# ---------------------------------------------------------------------------

def q_extract_players(spark: SparkSession, d: str) -> DataFrame:
    t = fixture_tables(spark, d)
    entries = I.collect_entries(_docs(N.player_list_docs(t), "player_lists"), N.PLAYER_LIST_KEYS)
    return I.extract_players(entries)


def q_extract_teams(spark: SparkSession, d: str) -> DataFrame:
    t = fixture_tables(spark, d)
    return I.extract_teams(_docs(N.team_list_docs(t), "team_list"))


def q_extract_venues(spark: SparkSession, d: str) -> DataFrame:
    t = fixture_tables(spark, d)
    return I.extract_venues(_docs(N.series_venue_docs(t), "series_venues"),
                            _docs(N.flat_match_list_docs(t), "match_list"))


def q_extract_matches(spark: SparkSession, d: str) -> DataFrame:
    from crease.plans.product_queries import scratch_dir

    t = fixture_tables(spark, d)
    out = I.extract_matches(_docs(N.match_list_docs(t), "match_list"), t["teams"], t["venues"],
                            stage_dir=scratch_dir(spark, "matches-stage"))
    return out["matches"]


def q_load_matches_fresh(spark: SparkSession, d: str) -> DataFrame:
    """I6 + I9 through the ingest workflow: all match lists into an empty table folder.

    Every team and venue is new, so each gets an id in name order; the stored
    matches must carry those ids.
    """
    from crease.operators.loads import load_matches
    from crease.plans.product_queries import scratch_dir
    from crease.sources.tables import load_table

    t = fixture_tables(spark, d)
    out = scratch_dir(spark, "fresh-tables")
    load_matches(_docs(N.match_list_docs(t), "match_list"), out, stage_dir=out + "-stage")
    return load_table(spark, out, "matches")


def q_assign_keys(spark: SparkSession, d: str) -> DataFrame:
    """Team names from the nations plus every part brand; brands get new ids after max(team_id)."""
    t = fixture_tables(spark, d)
    brands = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("team_name"))
    names = t["teams"].select("team_name").unionByName(brands)
    lookup, _new = assign_keys(names, t["teams"], "team_name", "team_id", {"country": I.UNKNOWN})
    return lookup.select("team_name", "team_id")


def q_ensure_members(spark: SparkSession, d: str) -> DataFrame:
    t = fixture_tables(spark, d)
    bat = I.extract_batting(_docs(N.scorecard_docs(spark, d), "scorecard"))
    return I.stub_players(bat, t["players"])


def q_extract_batting(spark: SparkSession, d: str) -> DataFrame:
    return I.extract_batting(_docs(N.scorecard_docs(spark, d), "scorecard")).drop("name", "innings_number")


def q_extract_bowling(spark: SparkSession, d: str) -> DataFrame:
    b = I.extract_bowling(_docs(N.scorecard_docs(spark, d), "scorecard"))
    return b.drop("name", "innings_number", "line_number")


def q_extract_player_match(spark: SparkSession, d: str) -> DataFrame:
    return I.extract_player_match(_docs(N.player_match_docs(spark, d), "player_matches"))


def q_extract_recent_form(spark: SparkSession, d: str) -> DataFrame:
    f = I.extract_recent_form(_docs(N.detailed_docs(fixture_tables(spark, d)), "detailed_scorecard"))
    return f.drop("innings_number", "line_number")


def q_extract_fielding(spark: SparkSession, d: str) -> DataFrame:
    f = I.extract_fielding(_docs(N.detailed_docs(fixture_tables(spark, d)), "detailed_scorecard"))
    return f.drop("stat_id", "innings_number", "line_number")


def q_extract_partnerships(spark: SparkSession, d: str) -> DataFrame:
    p = I.extract_partnerships(_docs(N.detailed_docs(fixture_tables(spark, d)), "detailed_scorecard"))
    return p.drop("partnership_id")


def q_extract_quarterly(spark: SparkSession, d: str) -> DataFrame:
    return I.extract_quarterly(_docs(N.batting_career_docs(spark, d), "career"))


def q_merge_format_summary(spark: SparkSession, d: str) -> DataFrame:
    bat, bowl = N.career_docs(spark, d)
    return I.merge_format_summary(_docs(bat, "career"), _docs(bowl, "career"))


def q_dedupe(spark: SparkSession, d: str) -> DataFrame:
    bs = fixture_tables(spark, d)["batting_stats"]
    rest = [c for c in bs.columns if c != "stat_id"]
    return dedupe(bs, ["stat_id"], rest)


def q_new_rows(spark: SparkSession, d: str) -> DataFrame:
    t = fixture_tables(spark, d)
    return new_rows(t["player_match"], t["player_recent_form"], ["player_id", "match_date"], null_safe=True)


def q_ingest_all(spark: SparkSession, d: str) -> DataFrame:
    """All scorecards and career documents -> five stored tables; report rows per table."""
    from crease.plans.product_queries import scratch_dir
    from crease.sources.tables import load_table

    t = fixture_tables(spark, d)
    bat, bowl = N.career_docs(spark, d)
    out = scratch_dir(spark, "ingest")
    reports = I.ingest_all(_docs(N.detailed_docs(t), "detailed_scorecard"), _docs(bat, "career"),
                           _docs(bowl, "career"), out)
    counts = [load_table(spark, out, r.table).agg(F.count(F.lit(1)).alias("stored_rows"))
              .select(F.lit(r.table).alias("table_name"), "stored_rows") for r in reports]
    result = counts[0]
    for c in counts[1:]:
        result = result.unionByName(c)
    return result


# ---------------------------------------------------------------------------
# constraints and change sets
# ---------------------------------------------------------------------------

def q_check_unique(spark: SparkSession, d: str) -> DataFrame:
    return check_unique(fixture_tables(spark, d)["batting_stats"], ["stat_id"])


def q_check_reference(spark: SparkSession, d: str) -> DataFrame:
    return reference_report(fixture_tables(spark, d), FOREIGN_KEYS)


def q_check_types(spark: SparkSession, d: str) -> DataFrame:
    t = fixture_tables(spark, d)
    return check_types(t["matches"], "matches", VARCHAR_WIDTHS["matches"])


def q_apply_changes(spark: SparkSession, d: str) -> DataFrame:
    players = fixture_tables(spark, d)["players"]
    result, _rejected = apply_changes(players, players_change_set(players), ["player_id"])
    return result


def q_display_players(spark: SparkSession, d: str) -> DataFrame:
    return display_players(fixture_tables(spark, d)["players"])


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "i03_extract_players": q_extract_players,
    "i04_extract_teams": q_extract_teams,
    "i05_extract_venues": q_extract_venues,
    "i06_extract_matches": q_extract_matches,
    "i07_dedupe": q_dedupe,
    "i08_new_rows": q_new_rows,
    "i09_assign_keys": q_assign_keys,
    "i09b_load_matches_fresh": q_load_matches_fresh,
    "i10_ensure_members": q_ensure_members,
    "i11_extract_batting": q_extract_batting,
    "i12_extract_bowling": q_extract_bowling,
    "i13_extract_player_match": q_extract_player_match,
    "i14_extract_quarterly": q_extract_quarterly,
    "i15_extract_recent_form": q_extract_recent_form,
    "i16_extract_fielding": q_extract_fielding,
    "i17_extract_partnerships": q_extract_partnerships,
    "i18_merge_format_summary": q_merge_format_summary,
    "i19_ingest_all": q_ingest_all,
    "c1_check_unique": q_check_unique,
    "c2_check_reference": q_check_reference,
    "c3_check_types": q_check_types,
    "c4_apply_changes": q_apply_changes,
    "c7_display_players": q_display_players,
}


# ---------------------------------------------------------------------------
# oracle SQL
# ---------------------------------------------------------------------------

_SCORE_ORDER = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate"
_LO_FULL = """(SELECT l.*, o.o_custkey, o.o_orderdate, CAST(l.l_quantity AS INTEGER) AS q,
   CASE l.l_returnflag WHEN 'A' THEN 'Test' WHEN 'N' THEN 'ODI' WHEN 'R' THEN 'T20I' END AS fmt
   FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""


def _fk_report_sql() -> str:
    parts = []
    for table, fks in FOREIGN_KEYS.items():
        for col, dim, key in fks:
            parts.append(f"SELECT '{table}' AS table_name, '{col}' AS column_name, '{dim}' AS ref_table, "
                         f"CAST(COUNT(*) FILTER (WHERE f.{col} IS NOT NULL AND d.{key} IS NULL) AS BIGINT) "
                         f"AS orphan_rows FROM {table} f LEFT JOIN (SELECT DISTINCT {key} FROM {dim}) d "
                         f"ON f.{col} = d.{key}")
    return "\nUNION ALL\n".join(parts)


def _types_sql() -> str:
    parts = []
    for col, width in VARCHAR_WIDTHS["matches"].items():
        parts.append(f"SELECT '{col}' AS column_name, CAST({width} AS BIGINT) AS max_width, "
                     f"CAST(COUNT(*) FILTER (WHERE LENGTH({col}) > {width}) AS BIGINT) AS violations, "
                     f"CAST(MAX(LENGTH({col})) AS BIGINT) AS longest FROM matches")
    return "\nUNION ALL\n".join(parts)


_ORACLES: dict[str, str] = {
    "i03_extract_players": """
SELECT player_id, full_name, 'Unknown' AS country, playing_role, batting_style,
       COALESCE(bowling_style, '') AS bowling_style FROM players""",
    "i04_extract_teams": "SELECT team_id, team_name, country FROM teams",
    "i05_extract_venues": """
SELECT DISTINCT venue_name, city, country, CAST(NULL AS BIGINT) AS capacity FROM venues""",
    "i06_extract_matches": """
SELECT match_id, match_description, match_date, match_status, team1_id, team2_id,
       COALESCE(winning_team, '') AS winning_team, CAST(victory_margin AS BIGINT) AS victory_margin,
       victory_type, venue_id, toss_winner, toss_decision FROM matches""",
    "i07_dedupe": """
SELECT stat_id, player_id, match_id, format, CAST(runs_scored AS BIGINT) AS runs_scored,
       CAST(balls_faced AS BIGINT) AS balls_faced, strike_rate,
       CAST(batting_position AS BIGINT) AS batting_position, is_out
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY stat_id ORDER BY player_id, match_id, format, runs_scored,
                                   balls_faced, strike_rate, batting_position, is_out) AS rn
      FROM batting_stats) WHERE rn = 1""",
    "i08_new_rows": """
SELECT pm.player_id, pm.match_date, CAST(pm.runs_scored AS BIGINT) AS runs_scored,
       CAST(pm.strike_rate AS DOUBLE) AS strike_rate
FROM player_match pm
WHERE NOT EXISTS (SELECT 1 FROM player_recent_form prf
                  WHERE prf.player_id IS NOT DISTINCT FROM pm.player_id
                    AND prf.match_date IS NOT DISTINCT FROM pm.match_date)""",
    "i09_assign_keys": """
SELECT team_name, team_id FROM teams
UNION ALL
SELECT b AS team_name, (SELECT MAX(team_id) FROM teams) + ROW_NUMBER() OVER (ORDER BY b) AS team_id
FROM (SELECT DISTINCT p_brand AS b FROM part WHERE p_brand NOT IN (SELECT team_name FROM teams))""",
    "i09b_load_matches_fresh": """
WITH used AS (
  SELECT m.*, t1.team_name AS t1n, t2.team_name AS t2n, v.venue_name AS vn
  FROM matches m
  LEFT JOIN teams t1 ON t1.team_id = m.team1_id
  LEFT JOIN teams t2 ON t2.team_id = m.team2_id
  LEFT JOIN venues v ON v.venue_id = m.venue_id),
team_ids AS (SELECT n, ROW_NUMBER() OVER (ORDER BY n) AS id
             FROM (SELECT t1n AS n FROM used UNION SELECT t2n FROM used)),
venue_ids AS (SELECT vn, ROW_NUMBER() OVER (ORDER BY vn) AS id FROM (SELECT DISTINCT vn FROM used))
SELECT u.match_id, u.match_description, u.match_date, u.match_status, a.id AS team1_id, b.id AS team2_id,
       COALESCE(u.winning_team, '') AS winning_team, CAST(u.victory_margin AS BIGINT) AS victory_margin,
       u.victory_type, c.id AS venue_id, u.toss_winner, u.toss_decision
FROM used u
JOIN team_ids a ON a.n = u.t1n
JOIN team_ids b ON b.n = u.t2n
JOIN venue_ids c ON c.vn = u.vn""",
    "i10_ensure_members": """
SELECT b.player_id, 'Unknown' AS full_name, 'Unknown' AS country, 'Unknown' AS playing_role,
       'Unknown' AS batting_style, 'Unknown' AS bowling_style
FROM (SELECT DISTINCT o_custkey AS player_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey) b
WHERE b.player_id NOT IN (SELECT player_id FROM players)""",
    "i11_extract_batting": f"""
SELECT o_custkey AS player_id, l_orderkey AS match_id, fmt AS format, CAST(q * 3 AS BIGINT) AS runs_scored,
       CAST(l_partkey % 120 AS BIGINT) AS balls_faced,
       CAST(CAST(l_partkey % 20000 AS DECIMAL(9,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DOUBLE) AS strike_rate,
       CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey, fmt ORDER BY {_SCORE_ORDER}) AS BIGINT) AS batting_position,
       l_linestatus = 'F' AS is_out
FROM {_LO_FULL}""",
    "i12_extract_bowling": f"""
SELECT o_custkey AS player_id, l_orderkey AS match_id, fmt AS format,
       CAST(q % 11 AS DOUBLE) AS overs_bowled, CAST(l_partkey % 90 AS BIGINT) AS runs_conceded,
       CAST(l_suppkey % 10 AS BIGINT) AS wickets_taken,
       CASE WHEN q % 11 <> 0 THEN CAST(CAST(l_partkey % 1500 AS DECIMAL(9,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DOUBLE)
            ELSE 0.0 END AS economy_rate
FROM {_LO_FULL}""",
    "i13_extract_player_match": f"""
SELECT o_custkey AS player_id, CAST(l_shipdate AS DATE) AS match_date, CAST(q * 3 AS BIGINT) AS runs_scored,
       CAST(printf('%.2f', (CAST(q * 3 AS DOUBLE) / CAST(l_partkey % 120 AS DOUBLE)) * 100) AS DOUBLE) AS strike_rate
FROM {_LO_FULL} WHERE l_partkey % 120 <> 0""",
    "i14_extract_quarterly": f"""
WITH monthly AS (
  SELECT o_custkey AS player_id, fmt AS format, YEAR(o_orderdate) AS year, MONTH(o_orderdate) AS month,
         SUM(q * 3) AS runs,
         ROUND(CAST(AVG(CAST(CAST(l_partkey % 20000 AS DECIMAL(9,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(5,2)))
                    AS DECIMAL(18,6)), 2) AS sr,
         COUNT(DISTINCT l_orderkey) AS matches
  FROM {_LO_FULL}
  GROUP BY o_custkey, fmt, YEAR(o_orderdate), MONTH(o_orderdate))
SELECT player_id, CAST(year AS BIGINT) AS year, CAST((month - 1) // 3 + 1 AS BIGINT) AS quarter, format,
       CAST(SUM(runs) AS BIGINT) AS total_runs,
       {r2('SUM(sr * matches) / NULLIF(SUM(matches), 0)')} AS strike_rate,
       CAST(SUM(matches) AS BIGINT) AS matches_played
FROM monthly GROUP BY player_id, year, (month - 1) // 3 + 1, format""",
    "i15_extract_recent_form": """
SELECT player_id, match_id, CAST(runs_scored AS BIGINT) AS runs_scored, CAST(balls_faced AS BIGINT) AS balls_faced,
       CAST(strike_rate AS DOUBLE) AS strike_rate, is_above_50, match_date
FROM player_recent_form""",
    "i16_extract_fielding": """
SELECT player_id, match_id, CAST(COALESCE(catches, 0) AS BIGINT) AS catches,
       CAST(stumpings AS BIGINT) AS stumpings, CAST(runouts AS BIGINT) AS runouts
FROM fielding_stats""",
    "i17_extract_partnerships": """
SELECT match_id, CAST(innings_number AS BIGINT) AS innings_number, player1_id, player2_id,
       CAST(batting_position1 AS BIGINT) AS batting_position1, CAST(batting_position2 AS BIGINT) AS batting_position2,
       CAST(partnership_runs AS BIGINT) AS partnership_runs
FROM batting_partnerships""",
    "i18_merge_format_summary": """
SELECT player_id, format, CAST(total_runs AS BIGINT) AS total_runs, CAST(total_wickets AS BIGINT) AS total_wickets,
       CAST(COALESCE(batting_average, 0) AS DOUBLE) AS batting_average,
       CAST(COALESCE(bowling_average, 0) AS DOUBLE) AS bowling_average,
       CAST(COALESCE(strike_rate, 0) AS DOUBLE) AS strike_rate,
       CAST(COALESCE(economy_rate, 0) AS DOUBLE) AS economy_rate,
       CAST(centuries AS BIGINT) AS centuries, CAST(matches_played AS BIGINT) AS matches_played,
       CAST(innings_played AS BIGINT) AS innings_played
FROM player_format_summary""",
    "i19_ingest_all": """
SELECT 'player_recent_form' AS table_name, CAST(COUNT(*) AS BIGINT) AS stored_rows
FROM (SELECT DISTINCT player_id, match_id FROM player_recent_form)
UNION ALL
SELECT 'fielding_stats', COUNT(*) FROM (SELECT DISTINCT match_id, player_id FROM fielding_stats)
UNION ALL
SELECT 'batting_partnerships', COUNT(*) FROM (SELECT DISTINCT match_id, innings_number, player1_id, player2_id,
                                                 batting_position1, batting_position2 FROM batting_partnerships)
UNION ALL
SELECT 'player_format_summary', COUNT(*) FROM player_format_summary
UNION ALL
SELECT 'player_quarterly_stats', COUNT(*) FROM player_quarterly_stats""",
    "c1_check_unique": """
SELECT stat_id, CAST(COUNT(*) AS BIGINT) AS row_count FROM batting_stats
GROUP BY stat_id HAVING COUNT(*) > 1 OR stat_id IS NULL""",
    "c2_check_reference": _fk_report_sql(),
    "c3_check_types": _types_sql(),
    "c4_apply_changes": """
SELECT player_id,
       full_name,
       CASE WHEN player_id % 10 = 1 THEN country || '_U' ELSE country END AS country,
       playing_role, batting_style, bowling_style
FROM players WHERE player_id % 10 <> 2
UNION ALL
SELECT p.player_id + (SELECT COUNT(*) FROM players) AS player_id, TRIM(p.full_name) AS full_name,
       TRIM(p.country) AS country, NULL AS playing_role, NULL AS batting_style, NULL AS bowling_style
FROM players p WHERE p.player_id % 10 = 0""",
    "c7_display_players": """
SELECT player_id AS "ID", full_name AS "Name", country AS "Team", playing_role AS "Role",
       batting_style AS "Batting Style", bowling_style AS "Bowling Style" FROM players""",
}


def operator_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from crease.plans.load_queries import load_queries
    from crease.plans.product_queries import product_queries

    def norm(fn):
        def run(spark: SparkSession, d: str) -> DataFrame:
            return normalize_types(fn(spark, d))
        run.__name__ = fn.__name__
        return run
    out = {k: norm(v) for k, v in _QUERIES.items()}
    out.update(product_queries())
    out.update(load_queries())
    return out


def operator_oracles() -> dict[str, str]:
    from crease.plans.load_queries import load_oracles
    from crease.plans.product_queries import product_oracles

    out = {**product_oracles(), **load_oracles()}
    for k, sql in _ORACLES.items():
        out[k] = with_tables(sql)
    return out
