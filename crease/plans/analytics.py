"""The named analytic questions as DataFrame plans.

Every function takes a `tables` mapping (name -> DataFrame) plus keyword
parameters whose defaults are the source's constants, and returns a lazy
DataFrame.  Building a plan starts no Spark job.

Plan notes that hold for the whole module
----------------------------------------
* Dimension lookups (players, teams, venues) join *after* aggregation where
  the grouping key is the dimension key: the join then sees one row per group
  instead of one per fact row.  This relies on the declared primary keys
  (checked by `crease.operators.quality.check_unique`).
* Aggregations use Spark's partial (map-side) hash aggregate, so a hot key
  (one team or player holding a third of all rows) is pre-combined per input
  partition before the shuffle.
* Joins carry no broadcast hint: Spark broadcasts a side only when its
  measured size is under `spark.sql.autoBroadcastJoinThreshold`, and AQE
  re-plans with runtime sizes; otherwise it sort-merge joins.
* Every ORDER BY, top-k and row_number has a unique tie-break, so results and their order are deterministic.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crease.functions.semantics import (
    avg_int_exact, days_back, div_decimal, greatest_strict, least_strict, pct2, round_approx,
    round_half_up, years_back,
)

from crease.operators.states import LG_K

Tables = Mapping[str, DataFrame]

FORMATS = ("Test", "ODI", "T20I")
COMPLETED = "Completed"


def _eq_text(col, value: str, case_insensitive: bool):
    """String equality; the source database compares case-insensitively."""
    if case_insensitive:
        return F.lower(col) == F.lower(F.lit(value))
    return col == F.lit(value)


def _dec(x) -> F.Column:
    """A weight/constant as an exact decimal literal."""
    return F.lit(Decimal(str(x)))


def _date(d):
    return _dt.date.fromisoformat(d) if isinstance(d, str) else d


# ---------------------------------------------------------------------------
# Q1-Q10
# ---------------------------------------------------------------------------

def q01_players_by_country(tables: Tables, country: str = "India",
                           case_insensitive: bool = False) -> DataFrame:
    p = tables["players"]
    return (p.filter(_eq_text(F.col("country"), country, case_insensitive))
            .select("full_name", "playing_role", "batting_style", "bowling_style"))


def _match_with_names(tables: Tables, m: DataFrame) -> DataFrame:
    """Matches with both team names and the venue."""
    teams = tables["teams"].select("team_id", "team_name")
    t1 = teams.select(F.col("team_id").alias("t1_id"), F.col("team_name").alias("team1"))
    t2 = teams.select(F.col("team_id").alias("t2_id"), F.col("team_name").alias("team2"))
    v = tables["venues"].select(F.col("venue_id").alias("v_id"), "venue_name", "city")
    return (m.join(t1, F.col("team1_id") == t1.t1_id)
            .join(t2, F.col("team2_id") == t2.t2_id)
            .join(v, F.col("venue_id") == v.v_id))


def q02_recent_matches(tables: Tables, days: int = 30, as_of=None) -> DataFrame:
    m = tables["matches"].filter(F.col("match_date") >= days_back(days, as_of))
    return (_match_with_names(tables, m)
            .orderBy(F.col("match_date").desc(), F.col("match_id").desc())
            .select("match_description", "team1", "team2", "venue_name", "city", "match_date"))


def q03_top_run_scorers(tables: Tables, fmt: str = "ODI", k: int = 10) -> DataFrame:
    pfs = (tables["player_format_summary"].filter(F.col("format") == fmt)
           .select("player_id", "total_runs", "batting_average", "centuries"))
    p = tables["players"].select("player_id", "full_name")
    top = pfs.join(p, "player_id").orderBy(F.col("total_runs").desc(), F.col("player_id").asc()).limit(k)
    return top.select("full_name", "total_runs", "batting_average", "centuries")


def q04_large_venues(tables: Tables, min_capacity: int = 50000) -> DataFrame:
    return (tables["venues"].filter(F.col("capacity") > min_capacity)
            .orderBy(F.col("capacity").desc(), F.col("venue_id").asc())
            .select("venue_name", "city", "country", "capacity"))


def q05_team_wins(tables: Tables, status: str = COMPLETED, case_insensitive: bool = False) -> DataFrame:
    m = tables["matches"].filter(_eq_text(F.col("match_status"), status, case_insensitive))
    # pre-aggregate wins per winner name, then join the (small) team list
    wins = m.groupBy("winning_team").agg(F.count(F.lit(1)).alias("n"))
    t = tables["teams"].select("team_name")
    if case_insensitive:
        cond = F.lower(wins.winning_team) == F.lower(t.team_name)
    else:
        cond = wins.winning_team == t.team_name
    return (wins.join(t, cond)
            .groupBy("team_name").agg(F.sum("n").alias("total_wins"))
            .orderBy(F.col("total_wins").desc(), F.col("team_name").asc()))


def q06_role_counts(tables: Tables) -> DataFrame:
    return tables["players"].groupBy("playing_role").agg(F.count(F.lit(1)).alias("player_count"))


def q07_high_score_by_format(tables: Tables) -> DataFrame:
    return tables["batting_stats"].groupBy("format").agg(F.max("runs_scored").alias("highest_score"))


def q08_series_in_year(tables: Tables, year: int = 2024) -> DataFrame:
    # YEAR(d) = y rewritten as a date range so the predicate reaches the scan
    lo, hi = _dt.date(year, 1, 1), _dt.date(year + 1, 1, 1)
    s = tables["series"]
    return (s.filter((F.col("start_date") >= F.lit(lo)) & (F.col("start_date") < F.lit(hi)))
            .select("series_name", "host_country", "match_type", "start_date", "total_matches"))


def q09_allrounders(tables: Tables, role: str = "All-rounder", min_runs: int = 1000,
                    min_wickets: int = 50) -> DataFrame:
    pfs = tables["player_format_summary"].filter(
        (F.col("total_runs") > min_runs) & (F.col("total_wickets") > min_wickets))
    p = tables["players"].filter(F.col("playing_role") == role).select("player_id", "full_name")
    return pfs.join(p, "player_id").select("full_name", "format", "total_runs", "total_wickets")


def q10_latest_completed(tables: Tables, k: int = 20, status: str = COMPLETED) -> DataFrame:
    """Last k completed matches with team and venue names.

    The joins keep only matches whose teams and venue are known, so the top-k
    comes after them; it is a map-side top-k of the joined rows.
    """
    m = (tables["matches"].filter(F.col("match_status") == status)
         .select("match_id", "match_description", "match_date", "team1_id", "team2_id", "winning_team",
                 "victory_margin", "victory_type", "venue_id"))
    top = _match_with_names(tables, m).orderBy(F.col("match_date").desc(), F.col("match_id").desc()).limit(k)
    return top.select("match_description", "team1", "team2", "winning_team", "victory_margin",
                      "victory_type", "venue_name", "match_date")


# ---------------------------------------------------------------------------
# Q11-Q20
# ---------------------------------------------------------------------------

def q11_cross_format(tables: Tables, formats: Sequence[str] = FORMATS, min_formats: int = 2) -> DataFrame:
    pfs = tables["player_format_summary"]
    test_f, odi_f, t20_f = formats
    g = (pfs.groupBy("player_id")
         .agg(F.max(F.when(F.col("format") == test_f, F.col("total_runs")).otherwise(0)).alias("test_runs"),
              F.max(F.when(F.col("format") == odi_f, F.col("total_runs")).otherwise(0)).alias("odi_runs"),
              F.max(F.when(F.col("format") == t20_f, F.col("total_runs")).otherwise(0)).alias("t20_runs"),
              round_half_up(F.avg("batting_average")).alias("overall_batting_avg"),
              F.count_distinct("format").alias("n_formats"))
         .filter(F.col("n_formats") >= min_formats))
    p = tables["players"].select("player_id", "full_name")
    return g.join(p, "player_id").select("full_name", "test_runs", "odi_runs", "t20_runs",
                                         "overall_batting_avg")


def q12_home_away_wins(tables: Tables, status: str = COMPLETED, case_insensitive: bool = False) -> DataFrame:
    m = (tables["matches"].filter(_eq_text(F.col("match_status"), status, case_insensitive))
         .select("winning_team", "venue_id"))
    # wins per (winner, venue) first: the join then sees one row per pair
    per_venue = m.groupBy("winning_team", "venue_id").agg(F.count(F.lit(1)).alias("n"))
    t = tables["teams"].select("team_name", F.col("country").alias("team_country"))
    v = tables["venues"].select(F.col("venue_id").alias("v_id"), F.col("country").alias("venue_country"))
    j = (per_venue.join(t, per_venue.winning_team == t.team_name)
         .join(v, per_venue.venue_id == v.v_id))
    return (j.groupBy("team_name")
            .agg(F.sum(F.when(F.col("team_country") == F.col("venue_country"), F.col("n")).otherwise(0))
                 .alias("home_wins"),
                 F.sum(F.when(F.col("team_country") != F.col("venue_country"), F.col("n")).otherwise(0))
                 .alias("away_wins")))


def q13_adjacent_partnerships(tables: Tables, gap: int = 1, min_runs: int = 100) -> DataFrame:
    bp = tables["batting_partnerships"].filter(
        (F.col("partnership_runs") >= min_runs)
        & (F.abs(F.col("batting_position1") - F.col("batting_position2")) == gap))
    p = tables["players"].select("player_id", "full_name")
    p1 = p.select(F.col("player_id").alias("p1_id"), F.col("full_name").alias("batsman1"))
    p2 = p.select(F.col("player_id").alias("p2_id"), F.col("full_name").alias("batsman2"))
    return (bp.join(p1, bp.player1_id == p1.p1_id)
            .join(p2, bp.player2_id == p2.p2_id)
            .select("batsman1", "batsman2", "partnership_runs", "innings_number"))


def q14_bowling_by_venue(tables: Tables, min_overs: float = 4.0, min_matches: int = 3) -> DataFrame:
    bs = (tables["bowling_stats"].filter(F.col("overs_bowled") >= _dec(min_overs))
          .select("player_id", "match_id", "wickets_taken", "economy_rate"))
    m = tables["matches"].select("match_id", "venue_id")
    g = (bs.join(m, "match_id")
         .groupBy("player_id", "venue_id")
         .agg(F.count(F.lit(1)).alias("matches_played"),
              F.sum("wickets_taken").alias("total_wickets"),
              round_half_up(F.avg("economy_rate")).alias("avg_economy"))
         .filter(F.col("matches_played") >= min_matches))
    p = tables["players"].select("player_id", "full_name")
    v = tables["venues"].select("venue_id", "venue_name")
    return (g.join(p, "player_id").join(v, "venue_id")
            .select("full_name", "venue_name", "matches_played", "total_wickets", "avg_economy"))


def close_match_predicate(runs_margin: int = 50, wickets_margin: int = 5):
    vt, vm = F.col("victory_type"), F.col("victory_margin")
    return ((vt == "Runs") & (vm < runs_margin)) | ((vt == "Wickets") & (vm < wickets_margin))


def q15_close_matches(tables: Tables, runs_margin: int = 50, wickets_margin: int = 5,
                      dedupe: bool = False) -> DataFrame:
    """Players' results in close matches.

    The source joins teams ON (team1_id = t.team_id OR team2_id = t.team_id),
    which Spark can only run as a nested-loop join.  The same rows come from
    exploding the distinct pair {team1_id, team2_id} and an equi-join.
    `dedupe=True` counts each (player, match) once instead of once per team.
    """
    m = (tables["matches"].filter(close_match_predicate(runs_margin, wickets_margin))
         .select("match_id", "winning_team",
                 F.explode(F.array_distinct(F.array("team1_id", "team2_id"))).alias("team_id")))
    t = tables["teams"].select("team_id", "team_name")
    # one row per (match, side): did that side win?
    sides = (m.join(t, "team_id")
             .select("match_id", F.when(F.col("winning_team") == F.col("team_name"), 1)
                     .otherwise(0).alias("won")))
    if dedupe:
        sides = sides.groupBy("match_id").agg(F.max("won").alias("won"))
    prf = tables["player_recent_form"].select("player_id", "match_id", "runs_scored")
    g = (prf.join(sides, "match_id")
         .groupBy("player_id")
         .agg(round_half_up(avg_int_exact("runs_scored")).alias("avg_runs"),
              F.count(F.lit(1)).alias("close_matches_played"),
              F.sum("won").alias("matches_won_by_team")))
    p = tables["players"].select("player_id", "full_name")
    return g.join(p, "player_id").select("full_name", "avg_runs", "close_matches_played",
                                         "matches_won_by_team")


def q16_yearly_batting(tables: Tables, since="2020-01-01", min_matches: int = 5) -> DataFrame:
    prf = tables["player_recent_form"].filter(F.col("match_date") >= F.lit(_date(since)))
    g = (prf.groupBy("player_id", F.year("match_date").alias("year"))
         .agg(round_half_up(avg_int_exact("runs_scored")).alias("avg_runs_per_match"),
              round_half_up(F.avg("strike_rate")).alias("avg_strike_rate"),
              F.count(F.lit(1)).alias("matches_played"))
         .filter(F.col("matches_played") >= min_matches))
    p = tables["players"].select("player_id", "full_name")
    return g.join(p, "player_id").select("full_name", "year", "avg_runs_per_match", "avg_strike_rate",
                                         "matches_played")


def q17_toss_advantage(tables: Tables, status: str = COMPLETED) -> DataFrame:
    m = tables["matches"].filter(F.col("match_status") == status)
    g = (m.groupBy("toss_decision")
         .agg(F.count(F.lit(1)).alias("total_matches"),
              F.sum(F.when(F.col("toss_winner") == F.col("winning_team"), 1).otherwise(0))
              .alias("toss_win_and_match_win")))
    return g.select("toss_decision", "total_matches", "toss_win_and_match_win",
                    pct2(F.col("toss_win_and_match_win"), F.col("total_matches")).alias("win_percentage"))


def _matches(approximate: bool) -> F.Column:
    """COUNT(DISTINCT match_id): exact, or a HyperLogLog estimate (0.8 % standard error) in one aggregation."""
    if approximate:
        return F.hll_sketch_estimate(F.hll_sketch_agg("match_id", LG_K))
    return F.count_distinct("match_id")


def q18_economical_bowlers(tables: Tables, formats: Sequence[str] = ("ODI", "T20I"),
                           min_matches: int = 10, min_overs_per_match: float = 2,
                           approximate: bool = False) -> DataFrame:
    bs = tables["bowling_stats"].filter(F.col("format").isin(list(formats)))
    g = (bs.groupBy("player_id")
         .agg(_matches(approximate).alias("matches_played"),
              F.sum("overs_bowled").alias("total_overs"),
              F.sum("runs_conceded").alias("total_runs"),
              F.sum("wickets_taken").alias("total_wickets"))
         .filter((F.col("matches_played") >= min_matches)
                 # SUM(overs) / COUNT(DISTINCT match) >= x, without a rounded division
                 & (F.col("total_overs") >= F.col("matches_played") * _dec(min_overs_per_match))))
    return (g.select("player_id", "matches_played", "total_overs", "total_runs", "total_wickets",
                     round_half_up(div_decimal(F.col("total_runs").cast("decimal(20,0)"),
                                               F.col("total_overs"), 4)).alias("economy_rate"))
            .orderBy(F.col("economy_rate").asc_nulls_first(), F.col("player_id").asc()))


def q19_consistent_batsmen(tables: Tables, min_balls: int = 10, since="2022-01-01",
                           min_rows: int = 5) -> DataFrame:
    prf = tables["player_recent_form"].filter(
        (F.col("balls_faced") >= min_balls) & (F.col("match_date") >= F.lit(_date(since))))
    return (prf.groupBy("player_id")
            .agg(round_half_up(avg_int_exact("runs_scored")).alias("avg_runs"),
                 round_approx(F.stddev_pop("runs_scored")).alias("run_std_dev"),
                 F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= min_rows)
            .select("player_id", "avg_runs", "run_std_dev")
            .orderBy(F.col("run_std_dev").asc_nulls_first(), F.col("player_id").asc()))


def q20a_format_counts(tables: Tables, formats: Sequence[str] = FORMATS, approximate: bool = False) -> DataFrame:
    bs = tables["batting_stats"]
    return (bs.groupBy("player_id")
            .agg(F.count(F.lit(1)).alias("total_rows"),
                 _matches(approximate).alias("matches_played"),
                 F.sum(F.when(F.col("format").isin(list(formats)), 1).otherwise(0)).alias("valid_format_rows"),
                 round_half_up(avg_int_exact("runs_scored")).alias("batting_avg")))


def q20b_format_counts_min(tables: Tables, formats: Sequence[str] = FORMATS, min_valid: int = 20,
                           approximate: bool = False) -> DataFrame:
    bs = tables["batting_stats"]
    return (bs.groupBy("player_id")
            .agg(_matches(approximate).alias("matches_played"),
                 round_half_up(avg_int_exact("runs_scored")).alias("batting_avg"),
                 F.sum(F.when(F.col("format").isin(list(formats)), 1).otherwise(0)).alias("valid"))
            .filter(F.col("valid") >= min_valid)
            .select("player_id", "matches_played", "batting_avg"))


# ---------------------------------------------------------------------------
# Q21-Q25
# ---------------------------------------------------------------------------

RANKING_WEIGHTS = dict(runs=0.01, bat_avg=0.5, strike_rate=0.3, wickets=2, bowl_avg_base=50,
                       bowl_avg=0.5, economy_base=6, economy=2, fielding=1.5)


def q21_performance_ranking(tables: Tables, preaggregate: bool = False, **weights) -> DataFrame:
    """Weighted batting / bowling / fielding points per (player, format).

    The source joins the summary to *every* fielding row of the player
    (USING player_id) before aggregating, so sums are multiplied by the number
    of fielding rows (SURVEY D13).  We reproduce that result exactly without
    materialising the fan-out: each side is aggregated on its own key and the
    multiplicities are applied arithmetically.  A hot player therefore costs
    one row, not |summary| x |fielding| rows.  `preaggregate=True` drops the
    multiplication (each fielding total counted once per format).
    """
    w = dict(RANKING_WEIGHTS)
    w.update(weights)
    # The summary holds one row per (player, format), so a partial aggregate
    # would not shrink it; partitioning it on player_id up front serves both
    # the (player, format) aggregate and the join with the per-player
    # fielding totals, which are themselves hash-partitioned on player_id.
    pfs = (tables["player_format_summary"].repartition("player_id").groupBy("player_id", "format")
           .agg(F.count(F.lit(1)).alias("n_pfs"),
                F.sum("total_runs").alias("sum_runs"),
                F.sum("total_wickets").alias("sum_wkts"),
                F.avg("batting_average").alias("avg_bat"),
                F.avg("strike_rate").alias("avg_sr"),
                F.avg("bowling_average").alias("avg_bowl"),
                F.avg("economy_rate").alias("avg_eco")))
    fld = (tables["fielding_stats"].groupBy("player_id")
           .agg(F.count(F.lit(1)).alias("n_fld"),
                F.sum(F.col("catches") + F.col("stumpings")).alias("sum_cs")))
    j = pfs.join(fld, "player_id")
    if preaggregate:
        runs, wkts, cs = F.col("sum_runs"), F.col("sum_wkts"), F.col("sum_cs")
    else:
        runs = F.col("sum_runs") * F.col("n_fld")
        wkts = F.col("sum_wkts") * F.col("n_fld")
        cs = F.col("sum_cs") * F.col("n_pfs")
    batting = runs * _dec(w["runs"]) + F.col("avg_bat") * _dec(w["bat_avg"]) \
        + F.col("avg_sr") * _dec(w["strike_rate"])
    bowling = wkts * _dec(w["wickets"]) + (_dec(w["bowl_avg_base"]) - F.col("avg_bowl")) * _dec(w["bowl_avg"]) \
        + (_dec(w["economy_base"]) - F.col("avg_eco")) * _dec(w["economy"])
    fielding = cs * _dec(w["fielding"])
    return (j.select("player_id", "format",
                     batting.cast("double").alias("batting_points"),
                     bowling.cast("double").alias("bowling_points"),
                     fielding.cast("double").alias("fielding_points"),
                     F.round(batting + bowling + fielding, 2).cast("double").alias("total_score"))
            .orderBy(F.col("total_score").desc_nulls_last(), F.col("player_id").asc(), F.col("format").asc()))


def q22a_head_to_head(tables: Tables, years: int = 3, min_matches: int = 5, as_of=None,
                      status: str = COMPLETED) -> DataFrame:
    """Unordered team pair record; a NULL team id drops the match (source LEAST/GREATEST)."""
    m = (tables["matches"]
         .filter((F.col("match_date") >= years_back(years, as_of)) & (F.col("match_status") == status))
         .select(least_strict("team1_id", "team2_id").alias("team_a"),
                 greatest_strict("team1_id", "team2_id").alias("team_b"),
                 "winning_team", "victory_margin"))
    t = tables["teams"].select("team_id", "team_name")
    ta = t.select(F.col("team_id").alias("team_a"), F.col("team_name").alias("a_name"))
    tb = t.select(F.col("team_id").alias("team_b"), F.col("team_name").alias("b_name"))
    j = m.join(ta, "team_a").join(tb, "team_b")
    a_won = F.col("winning_team") == F.col("a_name")
    b_won = F.col("winning_team") == F.col("b_name")
    return (j.groupBy("team_a", "team_b")
            .agg(F.count(F.lit(1)).alias("total_matches"),
                 F.sum(F.when(a_won, 1).otherwise(0)).alias("team_a_wins"),
                 F.sum(F.when(b_won, 1).otherwise(0)).alias("team_b_wins"),
                 round_half_up(avg_int_exact(F.when(a_won, F.col("victory_margin")))).alias("team_a_avg_margin"),
                 round_half_up(avg_int_exact(F.when(b_won, F.col("victory_margin")))).alias("team_b_avg_margin"))
            .filter(F.col("total_matches") >= min_matches))


def q22b_head_to_head_ordered(tables: Tables, years: int = 3, min_matches: int = 5, as_of=None) -> DataFrame:
    """Ordered (team1, team2) record, no status filter.

    The source compares the winner's *name* with a team *id* (SURVEY D9); we
    resolve the ids to names so the comparison is meaningful.
    """
    m = (tables["matches"].filter(F.col("match_date") >= years_back(years, as_of))
         .select("team1_id", "team2_id", "winning_team", "victory_margin"))
    t = tables["teams"].select("team_id", "team_name")
    t1 = t.select(F.col("team_id").alias("team1_id"), F.col("team_name").alias("t1_name"))
    t2 = t.select(F.col("team_id").alias("team2_id"), F.col("team_name").alias("t2_name"))
    j = m.join(t1, "team1_id", "left").join(t2, "team2_id", "left")
    w1 = F.col("winning_team") == F.col("t1_name")
    w2 = F.col("winning_team") == F.col("t2_name")
    return (j.groupBy("team1_id", "team2_id")
            .agg(F.count(F.lit(1)).alias("total_matches"),
                 F.sum(F.when(w1, 1).otherwise(0)).alias("team1_wins"),
                 F.sum(F.when(w2, 1).otherwise(0)).alias("team2_wins"),
                 round_half_up(avg_int_exact(F.when(w1, F.col("victory_margin")))).alias("team1_avg_margin"),
                 round_half_up(avg_int_exact(F.when(w2, F.col("victory_margin")))).alias("team2_avg_margin"))
            .filter(F.col("total_matches") >= min_matches))


def q23_recent_form(tables: Tables, short: int = 5, long: int = 10, fifty: int = 50,
                    excellent_sd: float = 10, excellent_avg: float = 50, good_sd: float = 15,
                    average_sd: float = 25) -> DataFrame:
    """Last-N form per player.

    `rn <= long` sits directly on the row_number window, so Spark plans a
    WindowGroupLimit before the shuffle: each map task forwards at most
    `long` rows per player, and a player with millions of rows never reaches
    one task whole.  match_id breaks ties between same-day rows.
    """
    prf = tables["player_recent_form"].select("player_id", "match_id", "match_date", "runs_scored")
    w = Window.partitionBy("player_id").orderBy(F.col("match_date").desc(), F.col("match_id").desc())
    recent = prf.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= long)
    sd = F.stddev_pop("runs_scored")
    mean = avg_int_exact("runs_scored")
    return (recent.groupBy("player_id")
            .agg(round_half_up(avg_int_exact(F.when(F.col("rn") <= short, F.col("runs_scored")))).alias("avg_last_5"),
                 round_half_up(mean).alias("avg_last_10"),
                 round_approx(sd).alias("consistency_score"),
                 F.sum(F.when(F.col("runs_scored") >= fifty, 1).otherwise(0)).alias("fifties_count"),
                 F.when((sd < excellent_sd) & (mean > excellent_avg), "Excellent Form")
                 .when(sd < good_sd, "Good Form")
                 .when(sd < average_sd, "Average Form")
                 .otherwise("Poor Form").alias("form_category")))


def q24_best_opening_pairs(tables: Tables, pos1: int = 1, pos2: int = 2, good_avg: float = 50,
                           k: int = 10) -> DataFrame:
    bp = tables["batting_partnerships"].filter(
        (F.col("batting_position1") == pos1) & (F.col("batting_position2") == pos2))
    g = (bp.groupBy(F.col("player1_id").alias("batsman1_id"), F.col("player2_id").alias("batsman2_id"))
         .agg(F.count(F.lit(1)).alias("partnership_count"),
              round_half_up(avg_int_exact("partnership_runs")).alias("avg_runs"),
              F.max("partnership_runs").alias("highest"),
              F.when(avg_int_exact("partnership_runs") > good_avg, "Good").otherwise("Average")
              .alias("good_partnerships")))
    return (g.orderBy(F.col("avg_runs").desc(), F.col("batsman1_id"), F.col("batsman2_id"))
            .limit(k))


def q25_quarterly_trend(tables: Tables, min_rows: int = 3) -> DataFrame:
    """Quarter-over-quarter strike-rate trend per player.

    The table is aggregated once; the previous qualifying quarter comes from
    `lag` over that (small, per-player) aggregate, and counts only when it is
    exactly one quarter earlier (the source's `qi = prev.qi + 1` join).  A
    player's window holds one row per quarter, so it is bounded by time, not
    by data volume.  AVG keeps decimal semantics: 4 places for the integer
    runs, 6 for the DECIMAL(5,2) rate.
    """
    pm = tables["player_match"].select("player_id", "match_date", "runs_scored", "strike_rate")
    return trend_of_quarters(
        pm.groupBy("player_id", F.year("match_date").alias("year"), F.quarter("match_date").alias("quarter"))
        .agg(F.count(F.lit(1)).alias("n"),
             avg_int_exact("runs_scored").alias("avg_runs"),
             F.avg("strike_rate").alias("avg_sr")), min_rows)


def trend_of_quarters(quarters: DataFrame, min_rows: int = 3) -> DataFrame:
    """Q25 from per-quarter averages (player_id, year, quarter, n, avg_runs, avg_sr)."""
    q = (quarters.filter(F.col("n") >= min_rows)
         .withColumn("quarter_index", F.col("year") * 4 + F.col("quarter"))
         # one range exchange on player_id serves both the per-player window
         # (clustered on player_id) and the final ORDER BY player_id, quarter
         # (a range partitioning on a prefix of the sort keys), so neither
         # needs its own shuffle
         .repartitionByRange("player_id"))
    w = Window.partitionBy("player_id").orderBy("quarter_index")
    prev_qi = F.lag("quarter_index").over(w)
    prev_sr = F.lag("avg_sr").over(w)
    q = q.withColumn("prev_avg_sr", F.when(F.col("quarter_index") - prev_qi == 1, prev_sr))
    trend = (F.when(F.col("avg_sr") > F.col("prev_avg_sr"), "Improving")
             .when(F.col("avg_sr") < F.col("prev_avg_sr"), "Declining")
             .otherwise("Stable"))
    return (q.orderBy("player_id", "quarter_index")
            .select("player_id",
                    F.concat(F.col("year").cast("string"), F.lit("-Q"), F.col("quarter").cast("string"))
                    .alias("quarter_label"),
                    F.col("avg_runs").cast("double").alias("avg_runs"),
                    F.col("avg_sr").cast("double").alias("avg_sr"),
                    F.col("prev_avg_sr").cast("double").alias("prev_avg_sr"),
                    trend.alias("trend")))


# ---------------------------------------------------------------------------
# Checks that sit next to the queries in the source (K1-K3)
# ---------------------------------------------------------------------------

def k1_close_match_list(tables: Tables, runs_margin: int = 50, wickets_margin: int = 5) -> DataFrame:
    return (tables["matches"].filter(close_match_predicate(runs_margin, wickets_margin))
            .select("match_id", "victory_type", "victory_margin"))


def k2_date_range(tables: Tables) -> DataFrame:
    prf = tables["player_recent_form"]
    return prf.agg(F.min("match_date").alias("min_match_date"), F.max("match_date").alias("max_match_date"))


def k3_join_coverage(tables: Tables) -> DataFrame:
    prf = tables["player_recent_form"].select("player_id")
    p = tables["players"].select("player_id")
    return prf.join(p, "player_id").agg(F.count(F.lit(1)).alias("joined_rows"))


ALL_QUERIES = {
    "q01_players_by_country": q01_players_by_country,
    "q02_recent_matches": q02_recent_matches,
    "q03_top_run_scorers": q03_top_run_scorers,
    "q04_large_venues": q04_large_venues,
    "q05_team_wins": q05_team_wins,
    "q06_role_counts": q06_role_counts,
    "q07_high_score_by_format": q07_high_score_by_format,
    "q08_series_in_year": q08_series_in_year,
    "q09_allrounders": q09_allrounders,
    "q10_latest_completed": q10_latest_completed,
    "q11_cross_format": q11_cross_format,
    "q12_home_away_wins": q12_home_away_wins,
    "q13_adjacent_partnerships": q13_adjacent_partnerships,
    "q14_bowling_by_venue": q14_bowling_by_venue,
    "q15_close_matches": q15_close_matches,
    "q16_yearly_batting": q16_yearly_batting,
    "q17_toss_advantage": q17_toss_advantage,
    "q18_economical_bowlers": q18_economical_bowlers,
    "q19_consistent_batsmen": q19_consistent_batsmen,
    "q20a_format_counts": q20a_format_counts,
    "q20b_format_counts_min": q20b_format_counts_min,
    "q21_performance_ranking": q21_performance_ranking,
    "q22a_head_to_head": q22a_head_to_head,
    "q22b_head_to_head_ordered": q22b_head_to_head_ordered,
    "q23_recent_form": q23_recent_form,
    "q24_best_opening_pairs": q24_best_opening_pairs,
    "q25_quarterly_trend": q25_quarterly_trend,
    "k1_close_match_list": k1_close_match_list,
    "k2_date_range": k2_date_range,
    "k3_join_coverage": k3_join_coverage,
}
