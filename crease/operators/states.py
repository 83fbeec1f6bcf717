"""Stored partial states that merge: moments and distinct sketches per player and period.

A moment state holds count, sum and sum of squares as exact decimals; sums of
states give the average, the population deviation and totals of any span of
periods without reading lines again.  A sketch state holds a HyperLogLog
sketch; the union of sketches estimates distinct values over any span.

States are stored in hash parts of the player (`upsert_rows`).  After a load,
:func:`refresh_states` computes the states of the loaded lines' periods again
from the stored lines of just these periods and replaces them, so it may be run
twice, and a load touches no other period.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crease.functions.semantics import div_decimal, round_approx
from crease.operators.keys import met_rows
from crease.operators.upsert import upsert_rows
from crease.sources.sinks import LoadReport

EXACT = "decimal(38,4)"
LG_K = 14  # 16384 registers: a relative standard error of 0.8 %; small sets are kept as lists


def month_of(date: str) -> Column:
    return F.trunc(date, "month")


def moments(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per key: rows, and for every value its non-NULL count, sum and sum of squares, exact."""
    out = [F.count(F.lit(1)).alias("n_rows")]
    for v in values:
        x = F.col(v).cast("decimal(18,2)")
        out += [F.count(v).alias(f"{v}_n"), F.sum(x).cast(EXACT).alias(f"{v}_sum"),
                F.sum(x * x).cast(EXACT).alias(f"{v}_squares")]
    return rows.groupBy(*keys).agg(*out)


def merge_moments(states: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The states of coarser keys."""
    out = [F.sum("n_rows").alias("n_rows")]
    for v in values:
        out += [F.sum(f"{v}_n").alias(f"{v}_n"), *[F.sum(f"{v}_{x}").cast(EXACT).alias(f"{v}_{x}")
                                                   for x in ("sum", "squares")]]
    return states.groupBy(*keys).agg(*out)


def mean_of(value: str, places: int) -> Column:
    """AVG as an exact decimal of so many places, NULL without values."""
    return div_decimal(F.col(f"{value}_sum"), F.col(f"{value}_n"), places)


def deviation_of(value: str) -> Column:
    """Population standard deviation: sqrt(n * squares - sum^2) / n, the difference taken exactly."""
    n, total, squares = (F.col(f"{value}_{x}") for x in ("n", "sum", "squares"))
    spread = n.cast("decimal(12,0)") * squares.cast("decimal(26,4)") \
        - total.cast("decimal(19,2)") * total.cast("decimal(19,2)")
    return F.sqrt(F.greatest(spread.cast("double"), F.lit(0.0))) / n


def distinct_states(rows: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str] = ()) -> DataFrame:
    """Per key: a sketch of the distinct values, the row count, and plain sums."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(value, LG_K).alias("sketch"), F.count(F.lit(1)).alias("n_rows"),
                                   *[F.sum(c).alias(c) for c in sums])


def merge_distinct(states: DataFrame, keys: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """Per coarser key: the estimated distinct count of the united sketches, the row count and sums."""
    return states.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"),
                                     F.sum("n_rows").alias("n_rows"), *[F.sum(c).alias(c) for c in sums])


def refresh_states(lines: DataFrame, touched: DataFrame, state_of: Callable[[DataFrame], DataFrame], base_dir: str,
                   table: str, keys: Sequence[str], part_keys: Sequence[str] = ("player_id",),
                   parts: int = 64) -> LoadReport:
    """Replace the stored states of the periods in `touched` (columns `keys`) by those of the stored `lines`.

    `lines` has the key columns; only its rows of touched keys are read into
    the aggregate, and only parts of the state table with a changed state are
    rewritten.
    """
    again = met_rows(lines, touched, keys, null_safe=True)
    return upsert_rows(state_of(again), base_dir, table, keys, part_keys=list(part_keys), parts=parts)


# ---------------------------------------------------------------------------
# questions from states
# ---------------------------------------------------------------------------

def form_states(lines: DataFrame, min_balls: int = 10) -> DataFrame:
    """Moments of runs per player and month of `player_recent_form` lines with enough balls (Q19)."""
    kept = lines.where(F.col("balls_faced") >= min_balls).withColumn("month", month_of("match_date"))
    return moments(kept, ["player_id", "month"], ["runs_scored"])


def consistent_batsmen_from_states(states: DataFrame, lines: DataFrame, since: str, min_balls: int = 10,
                                   min_rows: int = 5) -> DataFrame:
    """Q19 from `form_states`: whole months from their states, the lines of a broken first month alone."""
    first = F.to_date(F.lit(since))
    whole = states.where(F.col("month") >= first)
    # the month that `since` cuts, if it does not begin one: a date range that prunes the scan
    broken = lines.where((F.col("match_date") >= first) & (month_of(F.lit(since)) < first)
                         & (F.col("match_date") < F.add_months(F.trunc(F.lit(since).cast("date"), "month"), 1)))
    merged = merge_moments(whole.unionByName(form_states(broken, min_balls)), ["player_id"], ["runs_scored"])
    return merged.where(F.col("n_rows") >= min_rows).select(
        "player_id", F.round(mean_of("runs_scored", 4), 2).cast("double").alias("avg_runs"),
        round_approx(deviation_of("runs_scored")).alias("run_std_dev")) \
        .orderBy(F.col("run_std_dev").asc_nulls_first(), F.col("player_id").asc())


def match_states(lines: DataFrame) -> DataFrame:
    """Moments of runs and strike rate per player and month of `player_match` lines (Q25)."""
    return moments(lines.withColumn("month", month_of("match_date")), ["player_id", "month"],
                   ["runs_scored", "strike_rate"])


def quarters_from_states(states: DataFrame) -> DataFrame:
    """Q25's quarters from `match_states`: player_id, year, quarter, n, avg_runs (4 places), avg_sr (6 places)."""
    months = states.withColumns({"year": F.year("month"), "quarter": F.quarter("month")})
    merged = merge_moments(months, ["player_id", "year", "quarter"], ["runs_scored", "strike_rate"])
    return merged.select("player_id", "year", "quarter", F.col("n_rows").alias("n"),
                         mean_of("runs_scored", 4).alias("avg_runs"), mean_of("strike_rate", 6).alias("avg_sr"))


def bowling_states(lines: DataFrame, matches: DataFrame) -> DataFrame:
    """Match sketches and sums per player, format and quarter of the match (Q18, Q20); NULL quarter: unknown match."""
    when = matches.select("match_id", F.year("match_date").alias("year"), F.quarter("match_date").alias("quarter"))
    return distinct_states(lines.join(when, "match_id", "left"), ["player_id", "format", "year", "quarter"], "match_id",
                           ["overs_bowled", "runs_conceded", "wickets_taken"])


def economical_bowlers_from_states(states: DataFrame, formats: Sequence[str] = ("ODI", "T20I"), min_matches: int = 10,
                                   min_overs_per_match: float = 2) -> DataFrame:
    """Q18 from `bowling_states`, its distinct matches estimated."""
    sums = ["overs_bowled", "runs_conceded", "wickets_taken"]
    g = merge_distinct(states.where(F.col("format").isin(list(formats))), ["player_id"], sums)
    g = g.where((F.col("distinct") >= min_matches) & (F.col("overs_bowled") >= F.col("distinct") * min_overs_per_match))
    economy = div_decimal(F.col("runs_conceded").cast("decimal(20,0)"), F.col("overs_bowled"), 4)
    return g.select("player_id", F.col("distinct").alias("matches_played"), F.col("overs_bowled").alias("total_overs"),
                    F.col("runs_conceded").alias("total_runs"), F.col("wickets_taken").alias("total_wickets"),
                    F.round(economy, 2).cast("double").alias("economy_rate")) \
        .orderBy(F.col("economy_rate").asc_nulls_first(), F.col("player_id").asc())
