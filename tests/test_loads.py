"""End-to-end ingest workflows: a second run over the same documents adds nothing."""

import json

from crease.operators import loads as L
from crease.sources.documents import parse_documents
from crease.sources.schemas import doc_schema
from crease.sources.tables import load_table


def docs(spark, name, objs):
    good, _ = parse_documents(spark.createDataFrame([(json.dumps(o),) for o in objs], "value string"),
                              "value", doc_schema(name))
    return good


def test_load_workflows_are_idempotent(spark, tmpdir_path):
    base = tmpdir_path
    players = docs(spark, "player_lists", [{"player": [{"id": "1", "name": "A"}]},
                                           {"rank": [{"id": "2", "name": "B"}, {"id": "1", "name": "A"}]}])
    teams = docs(spark, "team_list", [{"list": [{"teamId": "1", "teamName": "Reds", "countryName": "R"}]}])
    series_v = docs(spark, "series_venues", [{"seriesVenue": [{"ground": "Oval", "city": "London", "country": "UK"},
                                                              {"ground": "Park"}]}])
    match_l = docs(spark, "match_list", [{"typeMatches": [{"seriesMatches": [{"seriesAdWrapper": {"matches": [
        {"matchInfo": {"matchId": "10", "startDate": "1700000000000", "team1": {"teamName": "Reds"},
                       "team2": {"teamName": "Blues"}, "venueInfo": {"ground": "Oval"}}}]}}]}]}])
    cards = docs(spark, "scorecard", [{"matchId": "10", "scorecard": [{
        "batsman": [{"id": "1", "runs": "5"}, {"id": "7", "name": "New", "runs": "9"}],
        "bowler": [{"id": "2", "overs": "4", "runs": "20", "wickets": "1"}]}]}])
    pm = docs(spark, "player_matches", [{"playerId": "1", "matchBattingStatsList": [
        {"matchDate": "2024-01-02", "runs": "5", "ballsFaced": "8"}]}])

    def run_all():
        reports = [L.load_players(players, base), L.load_teams(teams, base),
                   L.load_venues(series_v, None, base)]
        reports += L.load_matches(match_l, base)
        reports += L.load_batting(cards, base) + L.load_bowling(cards, base)
        reports.append(L.load_player_match(pm, base))
        return {(r.table, i): r.inserted for i, r in enumerate(reports)}

    first = run_all()
    assert sum(first.values()) > 0
    second = run_all()
    assert set(second.values()) == {0}, second
    venues = {r.venue_name: r.venue_id for r in load_table(spark, base, "venues").collect()}
    assert venues == {"Oval": 1, "Park": 2}                 # Oval reused by the match list
    teams_t = {r.team_name: r.team_id for r in load_table(spark, base, "teams").collect()}
    assert teams_t == {"Reds": 1, "Blues": 2}
    m = load_table(spark, base, "matches").first()
    assert (m.team1_id, m.team2_id, m.venue_id) == (1, 2, 1)
    names = {r.player_id: r.full_name for r in load_table(spark, base, "players").collect()}
    assert names == {1: "A", 2: "B", 7: "New"}             # id 7 stubbed from the scorecard
    assert load_table(spark, base, "batting_stats").count() == 2


def test_load_cli_from_files(spark, tmpdir_path):
    import os
    from crease import load
    landing = os.path.join(tmpdir_path, "landing")
    os.makedirs(landing)
    with open(os.path.join(landing, "p1.json"), "w") as fh:
        fh.write(json.dumps({"players": [{"id": "5", "name": "E"}, {"id": "6", "name": "F"}]}) + "\n")
        fh.write("not json\n")
        fh.write(json.dumps({"player": [{"id": "5", "name": "E-later"}]}) + "\n")
    tables = os.path.join(tmpdir_path, "tables")
    first = load.run(spark, "players", landing, tables)
    assert first == [{"table": "players", "inserted": 2, "rejected": 1}]
    again = load.run(spark, "players", landing, tables)
    assert again[0]["inserted"] == 0
    names = {r.player_id: r.full_name for r in load_table(spark, tables, "players").collect()}
    assert names == {5: "E", 6: "F"}                   # first occurrence in file order
