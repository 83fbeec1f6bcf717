"""Data products, sinks and the master ingest."""

import json

from pyspark.sql import functions as F

from crease.operators import ingest as I
from crease.operators import products as P
from crease.sources.documents import parse_documents
from crease.sources.schemas import doc_schema
from crease.sources.sinks import append_rows
from crease.sources.tables import create_tables, load_table


def docs(spark, name, objs):
    rows = [(json.dumps(o),) for o in objs]
    good, _ = parse_documents(spark.createDataFrame(rows, "value string"), "value", doc_schema(name))
    return good


MATCH_DOC = {"typeMatches": [{"matchType": "International", "seriesMatches": [
    {"seriesAdWrapper": {"seriesName": "Cup", "matches": [
        {"matchInfo": {"matchId": "11", "matchDesc": "1st", "startDate": "1700000000000", "status": "Won",
                       "team1": {"teamName": "Reds"}, "team2": {"teamName": "Blues"},
                       "tossResults": {"tossWinner": "Reds", "decision": "Bat"}, "matchWinner": "Reds",
                       "venueInfo": {"ground": "Oval", "city": "London"},
                       "matchScore": {"margin": {"value": "12", "type": "Runs"},
                                      "team1Score": {"inngs1": {"runs": "250", "wickets": "8", "overs": "50"}}}}},
        {"matchInfo": {"matchId": "12", "team1": {"teamName": "Greens"}, "team2": {"teamName": "Reds"},
                       "venueInfo": {"ground": "New Park"}}},
        {"matchInfo": {"matchId": "12", "matchDesc": "again"}}]}},
    {"adDetail": {}}]}]}


def test_extract_matches_creates_keys_and_reports_duplicates(spark):
    d = docs(spark, "match_list", [MATCH_DOC])
    teams = spark.createDataFrame([(3, "Reds", "X")], "team_id bigint, team_name string, country string")
    venues = spark.createDataFrame([(5, "Oval", "London", "UK", 1000)],
                                   "venue_id bigint, venue_name string, city string, country string, capacity int")
    out = I.extract_matches(d, teams, venues)
    new_teams = {r.team_name: r.team_id for r in out["new_teams"].collect()}
    assert new_teams == {"": 4, "Blues": 5, "Greens": 6}      # max(id) + 1 ..., in name order
    assert {r.country for r in out["new_teams"].collect()} == {"Unknown"}
    new_venues = {r.venue_name: (r.venue_id, r.capacity) for r in out["new_venues"].collect()}
    assert new_venues == {"": (6, 0), "New Park": (7, 0)}
    m = {r.match_id: r for r in out["matches"].collect()}
    assert set(m) == {11, 12}
    assert m[11].team1_id == 3 and m[11].team2_id == 5 and m[11].venue_id == 5
    assert m[11].victory_margin == 12 and str(m[11].match_date) == "2023-11-14"
    assert [r.match_id for r in out["duplicates"].collect()] == [12]
    assert (m[12].team1_id, m[12].match_description) == (6, "")      # the first occurrence wins


def test_match_board(spark):
    b = P.match_board(docs(spark, "match_list", [MATCH_DOC])).where("matchId = 11").first()
    assert b["label"] == "Reds vs Blues (Cup)"
    assert b["Start Date"] == "14 Nov 2023 10:13 PM"
    assert b["Team 1 Score"] == "250/8 in 50 overs"
    assert b["Team 2 Score"] == "–/– in – overs"
    assert b["Venue"] == "Oval, London"


def test_squads_both_shapes(spark):
    d = docs(spark, "squad", [
        {"matchId": "1", "team": [{"players": [{"name": "A", "playingRole": "Playing XI"},
                                               {"name": "B", "playingRole": "BENCH"},
                                               {"name": "C", "playingRole": "Umpire"}]}]},
        {"matchId": "2", "players": {"playing XI": ["D"], "bench": ["E", "F"]}}])
    got = sorted((r.matchId, r.group, r.name) for r in P.squads(d).collect())
    assert got == [(1, "bench", "B"), (1, "playing XI", "A"), (2, "bench", "E"), (2, "bench", "F"),
                   (2, "playing XI", "D")]


def test_rankings_stat_matrix_news(spark):
    r = docs(spark, "rankings", [{"formatType": "odi", "rank": [
        {"id": str(i), "name": f"P{i}", "country": "C", "rating": str(900 - i)} for i in range(20)]},
        {"formatType": "test", "rank": [{"id": "99", "rating": "999"}]}])
    top = P.rankings(r, "odi").collect()
    assert len(top) == 15 and top[0].name == "P0" and top[-1].name == "P14"
    m = docs(spark, "stat_matrix", [{"playerId": "7", "headers": ["Format", "Runs"],
                                     "values": [{"values": ["ODI", "10"]}, {"values": ["Test", "3", "extra"]}]}])
    cells = sorted((r.row_no, r.header, r.value) for r in P.stat_matrix(m).collect())
    assert cells == [(1, "Format", "ODI"), (1, "Runs", "10"), (2, "Format", "Test"), (2, "Runs", "3")]
    wide = P.stat_matrix_wide(m, ["Format", "Runs"]).orderBy("row_no").collect()
    assert [(w.Format, w.Runs) for w in wide] == [("ODI", "10"), ("Test", "3")]
    n = docs(spark, "news", [{"playerId": "1", "storyList": [
        {"story": {"hline": "H", "pubTime": "1700000000000", "coverImage": {"caption": "cap"}}},
        {"ad": {}}, {"story": {"hline": "H2", "pubTime": "bad"}}]}])
    rows = sorted((x.headline, x.published, x.caption) for x in P.news_feed(n).collect())
    assert rows == [("H", "14 Nov 2023", "cap"), ("H2", "–", None)]


def test_player_search_and_label(spark):
    players = spark.createDataFrame([(1, "Virat K", "India"), (2, "virat b", None), (3, "Joe", "Eng")],
                                    "player_id bigint, full_name string, country string")
    found = sorted(r.label for r in P.player_search(players, "VIRAT").collect())
    assert found == ["Virat K (India)", "virat b (–)"]
    assert P.player_by_label(players, "Joe (Eng)").first().player_id == 3


def test_append_rows_guard_and_report(spark, tmpdir_path):
    assert create_tables(spark, tmpdir_path, ["teams"]) == ["teams"]
    empty = spark.createDataFrame([], "team_id bigint, team_name string, country string")
    assert append_rows(empty, tmpdir_path, "teams").inserted == 0
    rows = spark.createDataFrame([(1, "A"), (2, "B")], "team_id int, team_name string")
    rep = append_rows(rows, tmpdir_path, "teams")
    assert rep.inserted == 2
    t = load_table(spark, tmpdir_path, "teams")
    assert t.count() == 2 and dict(t.dtypes)["team_id"] == "bigint"


def test_ingest_all_rerun_adds_nothing(spark, tmpdir_path):
    sc = docs(spark, "detailed_scorecard", [{"matchId": "5", "matchHeader": {"startDate": "1700000000000"},
                                             "innings": [{"inningsId": "1",
                                                          "batting": {"batters": [{"id": "1", "runs": "60"}]},
                                                          "fielding": {"players": [{"id": "2", "catches": "1"}]},
                                                          "partnerships": [{"batsmen": [{"id": "1", "position": "1"},
                                                                                        {"id": "3", "position": "2"}],
                                                                            "runs": "70"}]}]}])
    bat = docs(spark, "career", [{"playerId": "1", "stats": [{"format": "ODI", "runs": "60", "timeline": [
        {"year": "2023", "month": "11", "runs": "60", "strikeRate": "100", "matches": "1"}]}]}])
    bowl = docs(spark, "career", [{"playerId": "1", "stats": [{"format": "ODI", "wickets": "2"}]}])
    first = I.ingest_all(sc, bat, bowl, tmpdir_path)
    assert [r.inserted for r in first] == [1, 1, 1, 1, 1]
    from crease.sources.tables import load_tables
    stored = load_tables(spark, tmpdir_path, [r.table for r in first])
    again = I.ingest_all(sc, bat, bowl, tmpdir_path, existing=dict(stored))
    assert [r.inserted for r in again] == [0, 0, 0, 0, 0]
    prf = load_table(spark, tmpdir_path, "player_recent_form").first()
    assert prf.is_above_50 is True and str(prf.match_date) == "2023-11-14"


def test_replace_table_with_changes_read_from_itself(spark, tmpdir_path):
    from crease.operators.changes import apply_changes
    from crease.sources.sinks import replace_table
    players = spark.createDataFrame([(1, "A", "X"), (2, "B", "Y")], "player_id bigint, full_name string, country string")
    append_rows(players, tmpdir_path, "players")
    current = load_table(spark, tmpdir_path, "players")
    changes = spark.createDataFrame([("D", 1, 1, None, None), ("I", 2, 3, "C", "Z")],
                                    "op string, seq bigint, player_id bigint, full_name string, country string")
    result, _ = apply_changes(current, changes, ["player_id"])
    previous = replace_table(result, tmpdir_path, "players")
    assert sorted(r.player_id for r in load_table(spark, tmpdir_path, "players").collect()) == [2, 3]
    assert spark.read.parquet(previous).count() == 2


def test_extract_matches_staged_equals_lazy(spark, tmpdir_path):
    d = docs(spark, "match_list", [MATCH_DOC])
    teams = spark.createDataFrame([(3, "Reds", "X")], "team_id bigint, team_name string, country string")
    venues = spark.createDataFrame([(5, "Oval", "London", "UK", 1000)],
                                   "venue_id bigint, venue_name string, city string, country string, capacity int")
    lazy = I.extract_matches(d, teams, venues)
    staged = I.extract_matches(d, teams, venues, stage_dir=tmpdir_path)
    for k in ("matches", "new_teams", "new_venues", "duplicates"):
        assert sorted(lazy[k].collect()) == sorted(staged[k].collect()), k


def test_first_present_and_squad_lists(spark):
    df = spark.createDataFrame([(None, "b", "c"), ("a", None, "c"), (None, None, None)], "x string, y string, z string")
    assert [r.v for r in df.select(I.first_present("x", "y", "z").alias("v")).collect()] == ["b", "a", None]
    d = docs(spark, "squad", [{"matchId": "3", "team": [{"players": [{"name": "A", "playingRole": "Playing XI"},
                                                                       {"name": "B", "playingRole": "Playing XI"},
                                                                       {"name": "C", "playingRole": "Bench"}]}]}])
    got = {r.group: sorted(r.names) for r in P.squad_lists(d).collect()}
    assert got == {"playing XI": ["A", "B"], "bench": ["C"]}
