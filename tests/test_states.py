"""Mergeable states, distinct sketches, the trigram index and free keys of documents."""

import statistics

import pytest

from pyspark.sql import functions as F

from crease.operators import states as S
from crease.operators.products import player_search
from crease.operators.search_index import indexed_search, name_trigrams
from crease.operators.upsert import read_upserted, upsert_rows
from crease.sources.documents import variant_fields, variant_numbers


def test_merged_moments_equal_the_direct_ones(spark):
    rows = [(k % 3, f"2024-0{1 + k % 9}-11", (k * 37) % 101 if k % 7 else None, None if k % 3 == 2 else k / 4) for k in range(90)]
    df = spark.createDataFrame(rows, "player_id int, match_date string, runs_scored int, strike_rate double") \
        .withColumn("match_date", F.to_date("match_date"))
    states = S.match_states(df)
    assert states.count() == 9
    merged = S.merge_moments(states, ["player_id"], ["runs_scored", "strike_rate"]).select(
        "player_id", "n_rows", S.mean_of("runs_scored", 4).alias("mean"), S.deviation_of("runs_scored").alias("sd"),
        S.mean_of("strike_rate", 6).alias("rate"))
    for r in merged.collect():
        runs = [v for k, _, v, _ in rows if k == r.player_id and v is not None]
        assert r.n_rows == 30 and float(r["mean"]) == pytest.approx(statistics.mean(runs), abs=5.1e-5)
        assert r.sd == pytest.approx(statistics.pstdev(runs), rel=1e-12)
        assert (r.rate is None) == (r.player_id == 2)


def test_refresh_touches_only_the_periods_of_a_load(spark, tmpdir_path):
    lines = spark.range(600).selectExpr("id % 20 player_id", "date_add(date '2024-01-01', cast(id % 90 as int)) match_date",
                                        "cast(id % 50 as int) runs_scored", "12 balls_faced")
    upsert_rows(S.form_states(lines), tmpdir_path, "s", ["player_id", "month"], part_keys=["player_id"], parts=8)
    more = spark.createDataFrame([(4, 77)], "player_id bigint, runs_scored int").selectExpr(
        "player_id", "date '2024-02-02' match_date", "runs_scored", "12 balls_faced")
    stored = lines.unionByName(more).withColumn("month", S.month_of("match_date"))
    touched = more.select("player_id", S.month_of("match_date").alias("month"))
    report = S.refresh_states(stored, touched, S.form_states, tmpdir_path, "s", ["player_id", "month"])
    assert (report.inserted, report.updated) == (0, 1)
    got, want = (sorted(x.select("player_id", "month", "n_rows", "runs_scored_sum").collect())
                 for x in (read_upserted(spark, tmpdir_path, "s"), S.form_states(stored)))
    assert got == want
    again = S.refresh_states(stored, touched, S.form_states, tmpdir_path, "s", ["player_id", "month"])
    assert (again.inserted, again.updated) == (0, 0)


def test_sketches_unite_within_their_error(spark):
    rows = spark.range(200_000).selectExpr("id % 2 player_id", "id % 7 quarter", "id % 50000 match_id")
    states = S.distinct_states(rows, ["player_id", "quarter"], "match_id")
    for r in S.merge_distinct(states, ["player_id"]).collect():  # every match is in several quarters
        assert r["distinct"] == pytest.approx(25_000, rel=0.04) and r.n_rows == 100_000


def test_bowlers_from_sketches(spark):
    lines = spark.range(400).selectExpr("id % 4 player_id", "id % 40 match_id", "if(id % 2 = 0, 'ODI', 'Test') format",
                                        "cast(3 as decimal(4,1)) overs_bowled", "12 runs_conceded", "1 wickets_taken")
    matches = spark.range(30).selectExpr("id match_id", "date_add(date '2024-01-01', cast(id as int) * 20) match_date")
    got = S.economical_bowlers_from_states(S.bowling_states(lines, matches)).collect()
    assert [(r.player_id, r.matches_played, r.total_runs, r.economy_rate) for r in got] == [
        (0, 10, 1200, 4.0), (2, 10, 1200, 4.0)]


def test_indexed_search_equals_the_scan(spark):
    names = ["Abcabc", "ABC", "ab", None, "xabcx", "Ééé", "a%b_c", "bcabca"]
    players = spark.createDataFrame(list(enumerate(names)), "player_id int, full_name string").withColumn("country", F.lit("X"))
    index = name_trigrams(players)
    for needle in ("abc", "ABCABC", "ab", "", "ééé", "cab", "zzz", "%b_"):
        want, got = (sorted(r.player_id for r in x.collect())
                     for x in (player_search(players, needle), indexed_search(players, index, needle)))
        assert got == want, needle


def test_free_keys_of_documents(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": {"c": [1, "x"]}, "n": null}'), (2, "[1]"), (3, "no json"), (4, None),
                                (5, "{}"), (6, '{"z": "t"}')], "id int, doc string").withColumn("pos", F.lit(7))
    got = {(r.id, r.key): r.value for r in variant_fields(df, "doc").collect()}
    assert got == {(1, "a"): "1", (1, "b"): '{"c":[1,"x"]}', (1, "n"): got[1, "n"], (6, "z"): "t"}
    assert got[1, "n"] in (None, "null")


def test_numbers_of_documents_by_path(spark):
    df = spark.createDataFrame([(1, '{"a": "1.5", "t": [{"b": 2, "c": "x"}, {"b": "3"}], "n": null, "f": true}'), (2, "7"),
                                (3, '{"e": {}, "l": [], "m": [4, "-5"]}'), (4, None)], "id int, doc string")
    got = variant_numbers(df.withColumn("doc", F.parse_json("doc")), "doc", 3).collect()
    assert {(r.id, r.key): r.value for r in got} == {(1, "a"): 1.5, (1, "t[0].b"): 2.0, (1, "t[1].b"): 3.0, (2, ""): 7.0,
                                                     (3, "m[0]"): 4.0, (3, "m[1]"): -5.0}
    assert len(got) == 6


def test_all_numbers_of_career_entries(spark):
    from conftest import SF_SMALL
    from crease.plans.product_queries import product_queries

    keys = product_queries()["x24b_stat_variants"](spark, SF_SMALL)
    keys = {(r.kind, r.key) for r in keys.select("kind", F.regexp_replace("key", r"\[\d+\]", "").alias("key")).distinct().collect()}
    assert keys == {("batting", k) for k in ("runs", "average", "strikeRate", "hundreds", "matches", "innings",
                                             *(f"timeline.{k}" for k in ("year", "month", "runs", "strikeRate", "matches")))} \
        | {("bowling", k) for k in ("wickets", "average", "economyRate")}
