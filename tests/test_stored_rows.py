"""Loads keep every line and repeat; numbering, writes, plans and failures that earlier versions got wrong."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from crease import load
from crease.operators import ingest as I
from crease.operators import loads as L
from crease.operators.keys import consecutive_ids
from crease.plans import analytics as A
from crease.plans.registry import FIXTURE_PARAMS
from crease.sources.documents import parse_documents
from crease.sources.fixtures import fixture_tables
from crease.sources.schemas import doc_schema
from crease.sources.sinks import LoadReport
from crease.sources.tables import load_table, path_exists, write_partitioned_tables

SF = "/root/testdata/sf0.001"


def docs(spark, name, objs):
    text = spark.createDataFrame([(json.dumps(o),) for o in objs], "value string")
    return parse_documents(text, "value", doc_schema(name))[0]


def test_equal_lines_of_two_innings_are_both_stored(spark, tmpdir_path):
    innings = {"batsman": [{"id": "1", "runs": "5"}], "bowler": [{"id": "2", "overs": "4"}, {"id": "2", "overs": "4"}]}
    cards = docs(spark, "scorecard", [{"matchId": "9", "scorecard": [innings, innings]}] * 2)  # landed twice
    for expected in ((2, 4), (0, 0)):
        assert (L.load_batting(cards, tmpdir_path)[1].inserted, L.load_bowling(cards, tmpdir_path)[1].inserted) == expected
    bowling = load_table(spark, tmpdir_path, "bowling_stats")
    assert bowling.select("stat_id").distinct().count() == bowling.count() == 4
    assert sorted((r.innings_number, r.line_number) for r in bowling.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_player_match_keeps_repeats_and_rejects_bad_rates(spark, tmpdir_path):
    entries = [{"matchDate": "2024-01-02", "runs": "5", "ballsFaced": b} for b in ("8", "8", "4", "0", "x")]
    entries += [{"matchDate": "2024-01-02", "runs": "90", "ballsFaced": "1"}, {"matchDate": "soon", "runs": "1", "ballsFaced": "1"}]
    d = docs(spark, "player_matches", [{"playerId": "1", "matchBattingStatsList": entries}])
    first, again = L.load_player_match(d, tmpdir_path), L.load_player_match(d, tmpdir_path)
    assert (first.inserted, first.rejected, again.inserted) == (3, 3, 0)
    more = docs(spark, "player_matches", [{"playerId": "1", "matchBattingStatsList": [*entries, entries[0]]}])
    assert L.load_player_match(more, tmpdir_path).inserted == 1


def test_unreadable_numbers_are_faults_and_missing_ones_defaults(spark):
    bowl = [{"id": "1", "overs": "4", "runs": "1,200", "econ": "120.0"}, {"id": "2"}, {"id": "3", "runs": "abc", "wickets": "?"}]
    d = docs(spark, "scorecard", [{"matchId": "1", "scorecard": [{"bowler": bowl}]}])
    got = {r.player_id: (r.runs_conceded, r.fault) for r in I.extract_bowling(d, with_faults=True).collect()}
    assert got == {1: (1200, "economy_rate"), 2: (0, ""), 3: (0, "runs_conceded,wickets_taken")}
    assert L.load_bowling(d, tempfile.mkdtemp(prefix="run-test-"))[1] == LoadReport("bowling_stats", 1, 0, 2)
    career = docs(spark, "career", [{"playerId": "1", "stats": [
        {"format": "ODI", "runs": "many", "timeline": [{"year": "2020", "month": "x"}, {"year": "2020", "runs": "4"}]}]}])
    assert [r.fault for r in I.career_faults(career, I.BATTING_FIELDS).collect()] == ["runs"]
    assert [(r.year, r.total_runs) for r in I.extract_quarterly(career, reject=True).collect()] == [(2020, 4)]
    assert I.merge_format_summary(career, career.where("false"), reject=True).count() == 0


def test_ingest_all_reads_the_stored_tables_itself(spark, tmpdir_path):
    card = {"matchId": "5", "matchHeader": {"startDate": "1700000000000"}, "innings": [
        {"inningsId": str(k), "batting": {"batters": [{"id": "1", "runs": "60"}]},
         "fielding": {"players": [{"id": "2", "catches": "1"}, {"id": "3", "catches": "two"}]}} for k in (1, 2)]}
    sc, none = docs(spark, "detailed_scorecard", [card]), docs(spark, "career", [{}])
    first = {r.table: (r.inserted, r.rejected) for r in I.ingest_all(sc, none, none, tmpdir_path)}
    assert first["player_recent_form"] == (2, 0) and first["fielding_stats"] == (2, 2)
    assert [r.inserted for r in I.ingest_all(sc, none, none, tmpdir_path)] == [0] * 5


def test_master_load_from_files_counts_rejects(spark, tmpdir_path):
    def land(name, *lines):
        path = os.path.join(tmpdir_path, name)
        spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),) for x in lines], "value string") \
            .coalesce(1).write.text(path)
        return path

    cards = land("cards", {"matchId": "5", "matchHeader": {"startDate": "1700000000000"}, "innings": [
        {"inningsId": "1", "batting": {"batters": [{"id": "1", "runs": "60"}]}}]}, "broken {")
    bat = land("bat", {"playerId": "1", "stats": [{"format": "ODI", "runs": "60"}, {"format": "T20I", "runs": "x"}]})
    bowl = land("bowl", {"playerId": "1", "stats": [{"format": "ODI", "wickets": "2"}]}, "no")
    out = os.path.join(tmpdir_path, "tables")
    got = {r["table"]: (r["inserted"], r["rejected"]) for r in load.run(spark, "master", cards, out, bat, docs3=bowl)}
    assert got["player_recent_form"] == (1, 2) and got["player_format_summary"] == (1, 3)
    assert {r["inserted"] for r in load.run(spark, "master", cards, out, bat, docs3=bowl)} == {0}


@pytest.mark.parametrize("aqe", ["true", "false"])
def test_consecutive_ids_with_payload_are_gapless(spark, aqe):
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    try:
        rows = spark.range(1_000_000, numPartitions=8).select(
            F.xxhash64("id").alias("key"), F.repeat(F.lit("x"), 20).alias("payload"))
        ids = consecutive_ids(rows, ["key"], start=5)
        got = ids.agg(F.count_distinct("id"), F.min("id"), F.max("id")).first()
        assert tuple(got) == (1_000_000, 5, 1_000_004)
        assert ids.where("id = 5").first().key == ids.agg(F.min("key")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


@pytest.mark.parametrize("name", ["q03_top_run_scorers", "q10_latest_completed"])
def test_building_a_top_k_plan_starts_no_job(spark, name):
    t = fixture_tables(spark, SF)
    for table in ("players", "player_format_summary", "matches", "teams", "venues"):
        t[table]  # builds the derived tables' plans first
    spark.sparkContext.setJobGroup("plan-only", name)
    try:
        A.ALL_QUERIES[name](t, **FIXTURE_PARAMS.get(name, {}))
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("plan-only")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_large_format_is_written_by_several_tasks(spark, tmpdir_path):
    rows = spark.range(200_000, numPartitions=8).selectExpr(
        "id as stat_id", "id as player_id", "id as match_id", "if(id % 10 < 8, 'ODI', 'Test') as format")
    was = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "512k")
    try:
        write_partitioned_tables({"batting_stats": rows}, tmpdir_path)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", was)
    folder = os.path.join(tmpdir_path, "batting_stats", "format=ODI")
    assert len([f for f in os.listdir(folder) if f.endswith(".parquet")]) > 1
    assert load_table(spark, tmpdir_path, "batting_stats").groupBy("format").count().orderBy("format").collect() == [
        ("ODI", 160_000), ("Test", 40_000)]


def test_only_a_missing_path_is_absent(spark, tmpdir_path):
    assert not path_exists(spark, os.path.join(tmpdir_path, "nothing"))
    assert path_exists(spark, tmpdir_path)
    with pytest.raises(Exception, match="No FileSystem for scheme"):
        path_exists(spark, "nosuchscheme://x/y")


def test_a_cluster_must_name_the_shared_folder():
    from crease.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
