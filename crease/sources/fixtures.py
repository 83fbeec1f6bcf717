"""Derive the 13 target tables from the TPC-H-like test tables (FIXTURES.md).

Only integer arithmetic, CASE and joins are used, so an independent SQL
engine can build the same rows (the oracle side lives in
`crease.plans.oracle_sql`).  Every table is a lazy DataFrame plan: nothing
is read until a query needs it, and column pruning reaches the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.functions.semantics import hundredths, round_dec
from crease.sources.tables import TableSet

# Fixed mapping values of the test-table derivation (FIXTURES.md).
FORMAT_BY_RETURNFLAG = {"A": "Test", "N": "ODI", "R": "T20I"}
STATUS_BY_ORDERSTATUS = {"F": "Completed", "O": "Scheduled", "P": "Abandoned"}
TEAM_COUNT = 8


def _case(col, mapping: dict[str, str]):
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, v) if expr is None else expr.when(col == k, v)
    return expr


def read_base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture_tables(spark: SparkSession, sf_dir: str, stage_dir: str | None = None,
                   stored: TableSet | None = None) -> TableSet:
    """Lazy TableSet of the 13 derived tables for one test-data directory.

    `stage_dir`: write the lineitem ⨝ orders join there once and read it back,
    instead of recomputing it for each of the four tables built from it.
    `stored`: already-written tables; the summary is then aggregated from the
    stored batting / bowling tables rather than from their lineage.
    """
    base = {}
    staged = {}

    def b(name: str) -> DataFrame:
        if name not in base:
            base[name] = read_base(spark, sf_dir, name)
        return base[name]

    def lo() -> DataFrame:
        if stage_dir is None:
            return lo_plan()
        if "lo" not in staged:
            path = f"{stage_dir}/_lineitem_orders"
            lo_plan().write.mode("overwrite").parquet(path)
            staged["lo"] = spark.read.parquet(path)
        return staged["lo"]

    def lo_plan() -> DataFrame:
        # lineitem ⨝ orders: fact-to-fact equi-join on the order key
        li = b("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                  "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
        od = b("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        return (li.join(od, li.l_orderkey == od.o_orderkey)
                .withColumn("q", F.col("l_quantity").cast("int"))
                .withColumn("fmt", _case(F.col("l_returnflag"), FORMAT_BY_RETURNFLAG)))

    def players() -> DataFrame:
        c, n = b("customer"), b("nation")
        return (c.join(n, c.c_nationkey == n.n_nationkey)
                .select(F.col("c_custkey").alias("player_id"),
                        F.col("c_name").alias("full_name"),
                        F.col("n_name").alias("country"),
                        F.col("c_mktsegment").alias("playing_role"),
                        F.when(F.col("c_custkey") % 2 == 0, "Right").otherwise("Left").alias("batting_style"),
                        F.when(F.col("c_custkey") % 3 != 0, "Seam").alias("bowling_style")))

    def teams() -> DataFrame:
        n, r = b("nation"), b("region")
        return (n.join(r, n.n_regionkey == r.r_regionkey)
                .select(F.col("n_nationkey").cast("bigint").alias("team_id"),
                        F.col("n_name").alias("team_name"),
                        F.col("r_name").alias("country")))

    def venues() -> DataFrame:
        s, n, r = b("supplier"), b("nation"), b("region")
        return (s.join(n, s.s_nationkey == n.n_nationkey)
                .join(r, n.n_regionkey == r.r_regionkey)
                .select(F.col("s_suppkey").alias("venue_id"),
                        F.col("s_name").alias("venue_name"),
                        F.col("n_name").alias("city"),
                        F.col("r_name").alias("country"),
                        F.floor(F.col("s_acctbal") * 10).cast("int").alias("capacity")))

    def series() -> DataFrame:
        p = b("part")
        return p.select(F.col("p_partkey").alias("series_id"),
                        F.col("p_name").alias("series_name"),
                        F.col("p_brand").alias("host_country"),
                        F.col("p_type").alias("match_type"),
                        F.date_add(F.lit("2023-01-01").cast("date"),
                                   ((F.col("p_partkey") * 5) % 1000).cast("int")).alias("start_date"),
                        F.col("p_size").alias("total_matches"))

    def matches() -> DataFrame:
        o = b("orders")
        k = F.col("o_orderkey")
        names = b("nation").select("n_nationkey", "n_name")
        t1n = names.select(F.col("n_nationkey").alias("k1"), F.col("n_name").alias("t1_name"))
        t2n = names.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("t2_name"))
        m = (o.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
             .withColumn("t1", F.col("o_custkey") % TEAM_COUNT)
             .withColumn("t2", (F.col("o_custkey") + 1 + F.col("o_orderkey") % 7) % TEAM_COUNT))
        m = m.join(t1n, m.t1 == t1n.k1, "left").join(t2n, m.t2 == t2n.k2, "left")
        k10 = k % 10
        return m.select(
            k.alias("match_id"),
            F.col("o_orderpriority").alias("match_description"),
            F.col("o_orderdate").cast("date").alias("match_date"),
            _case(F.col("o_orderstatus"), STATUS_BY_ORDERSTATUS).alias("match_status"),
            F.col("t1").cast("bigint").alias("team1_id"),
            F.col("t2").cast("bigint").alias("team2_id"),
            F.when(k10 < 5, F.col("t1_name")).when(k10 < 9, F.col("t2_name")).alias("winning_team"),
            F.when(k10 == 9, None).when(k % 2 == 0, (k % 150).cast("int"))
             .otherwise((1 + k % 10).cast("int")).alias("victory_margin"),
            F.when(k10 == 9, None).when(k % 2 == 0, "Runs").otherwise("Wickets").alias("victory_type"),
            k10.cast("bigint").alias("venue_id"),
            F.when(k % 3 == 0, F.col("t1_name")).otherwise(F.col("t2_name")).alias("toss_winner"),
            F.when(k % 5 < 2, "Bat").otherwise("Bowl").alias("toss_decision"))

    def batting_stats() -> DataFrame:
        return lo().select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("stat_id"),
            F.col("o_custkey").alias("player_id"),
            F.col("l_orderkey").alias("match_id"),
            F.col("fmt").alias("format"),
            (F.col("q") * 3).cast("int").alias("runs_scored"),
            (F.col("l_partkey") % 120).cast("int").alias("balls_faced"),
            hundredths(F.col("l_partkey") % 20000, 9).cast("double").alias("strike_rate"),
            F.col("l_linenumber").cast("int").alias("batting_position"),
            (F.col("l_linestatus") == "F").alias("is_out"))

    def bowling_stats() -> DataFrame:
        q11 = F.col("q") % 11
        return lo().select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("stat_id"),
            F.col("o_custkey").alias("player_id"),
            F.col("l_orderkey").alias("match_id"),
            F.col("fmt").alias("format"),
            q11.cast("decimal(4,1)").alias("overs_bowled"),
            (F.col("l_partkey") % 90).cast("int").alias("runs_conceded"),
            (F.col("l_suppkey") % 10).cast("int").alias("wickets_taken"),
            F.when(q11 != 0, hundredths(F.col("l_partkey") % 1500, 4)).alias("economy_rate"))

    def player_match() -> DataFrame:
        return lo().select(
            F.col("o_custkey").alias("player_id"),
            F.col("l_shipdate").cast("date").alias("match_date"),
            (F.col("q") * 3).cast("int").alias("runs_scored"),
            hundredths(F.col("l_partkey") % 20000, 5).alias("strike_rate"))

    def fielding_stats() -> DataFrame:
        k = F.col("o_orderkey")
        return b("orders").select(
            k.alias("stat_id"),
            F.col("o_custkey").alias("player_id"),
            k.alias("match_id"),
            F.when(k % 13 != 0, (k % 4).cast("int")).alias("catches"),
            F.when(k % 3 == 0, 1).otherwise(0).alias("stumpings"),
            (k % 2).cast("int").alias("runouts"))

    def batting_partnerships() -> DataFrame:
        li = b("lineitem")
        return li.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("partnership_id"),
            F.col("l_orderkey").alias("match_id"),
            (F.col("l_linenumber") % 2 + 1).cast("int").alias("innings_number"),
            F.col("l_suppkey").alias("player1_id"),
            (F.col("l_suppkey") + F.col("l_linenumber")).alias("player2_id"),
            F.col("l_linenumber").cast("int").alias("batting_position1"),
            (F.col("l_linenumber") + 1 + F.col("l_partkey") % 2).cast("int").alias("batting_position2"),
            (F.col("l_quantity").cast("int") * 4).cast("int").alias("partnership_runs"))

    def player_format_summary() -> DataFrame:
        src = stored if stored is not None else tables
        return summarise_formats(src["batting_stats"], src["bowling_stats"])

    def player_quarterly_stats() -> DataFrame:
        d = F.col("o_orderdate")
        return (lo()
                .groupBy(F.col("o_custkey").alias("player_id"),
                         F.year(d).cast("int").alias("year"),
                         F.quarter(d).cast("int").alias("quarter"),
                         F.col("fmt").alias("format"))
                .agg(F.sum(F.col("q") * 3).cast("int").alias("total_runs"),
                     round_dec(F.avg(hundredths(F.col("l_partkey") % 20000, 5)), 5).alias("strike_rate"),
                     F.count_distinct("l_orderkey").cast("int").alias("matches_played")))

    def player_recent_form() -> DataFrame:
        o = b("orders")
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        runs = ((F.floor(F.col("o_totalprice")) % (20 + 25 * (c % 5)))
                + F.when(c % 5 == 0, 55).otherwise(0)).cast("int")
        return (o.select(c.alias("player_id"), k.alias("match_id"), runs.alias("runs_scored"),
                         (k % 90).cast("int").alias("balls_faced"),
                         hundredths(k % 20000, 5).alias("strike_rate"),
                         F.col("o_orderdate").cast("date").alias("match_date"))
                .select("player_id", "match_id", "runs_scored", "balls_faced", "strike_rate",
                        (F.col("runs_scored") >= 50).alias("is_above_50"), "match_date"))

    builders = {
        "players": players, "teams": teams, "venues": venues, "series": series,
        "matches": matches, "batting_stats": batting_stats, "bowling_stats": bowling_stats,
        "player_match": player_match, "fielding_stats": fielding_stats,
        "batting_partnerships": batting_partnerships,
        "player_format_summary": player_format_summary,
        "player_quarterly_stats": player_quarterly_stats,
        "player_recent_form": player_recent_form,
    }
    tables = TableSet(builders)
    return tables


def summarise_formats(batting: DataFrame, bowling: DataFrame) -> DataFrame:
    """player_format_summary from per-innings batting and bowling rows.

    Each side is aggregated to one row per (player, format) *before* the join,
    so the join is 1:1 and never multiplies raw rows.
    """
    bat = (batting.groupBy("player_id", "format")
           .agg(F.sum("runs_scored").alias("runs"),
                F.count(F.lit(1)).alias("innings"),
                F.count_distinct("match_id").alias("matches"),
                F.sum(F.when(F.col("runs_scored") >= 100, 1).otherwise(0)).alias("hundreds"),
                F.avg("strike_rate").alias("avg_sr")))
    bowl = (bowling.groupBy("player_id", "format")
            .agg(F.sum("wickets_taken").alias("wickets"),
                 F.sum("runs_conceded").alias("conceded"),
                 F.sum("overs_bowled").alias("overs")))
    j = bat.join(bowl, ["player_id", "format"], "full_outer")
    return j.select("player_id", "format", *[c.alias(n) for n, c in format_summary().items()])


def format_summary() -> dict[str, Column]:
    """The summary's columns from the sums of a player's format (NULL sums: none of that side)."""
    return {"total_runs": F.coalesce(F.col("runs"), F.lit(0)).cast("int"),
            "total_wickets": F.coalesce(F.col("wickets"), F.lit(0)).cast("int"),
            "batting_average": round_dec(F.try_divide(F.col("runs"), F.col("innings").cast("double")), 5),
            "bowling_average": round_dec(F.try_divide(F.col("conceded"), F.col("wickets").cast("double")), 5),
            "strike_rate": round_dec(F.col("avg_sr"), 5),
            "economy_rate": round_dec(F.try_divide(F.col("conceded"), F.col("overs").cast("double")), 5),
            "centuries": F.coalesce(F.col("hundreds"), F.lit(0)).cast("int"),
            "matches_played": F.coalesce(F.col("matches"), F.lit(0)).cast("int"),
            "innings_played": F.coalesce(F.col("innings"), F.lit(0)).cast("int")}
