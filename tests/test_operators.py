"""Hand cases for keys, ingest extractors, checks and change sets."""

import json

import pytest

from pyspark.sql import functions as F

from crease.operators import ingest as I
from crease.operators.changes import apply_changes
from crease.operators.keys import assign_keys, consecutive_ids, dedupe, ensure_members, new_rows
from crease.operators.quality import check_castable, check_reference, check_unique
from crease.sources.documents import parse_documents, read_documents
from crease.sources.schemas import doc_schema


def docs(spark, name, objs):
    rows = [(o if isinstance(o, str) else json.dumps(o),) for o in objs]
    good, bad = parse_documents(spark.createDataFrame(rows, "value string"), "value", doc_schema(name))
    return good, bad


def test_dedupe_keeps_first_by_order(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "z", 5)], "k int, v string, o int")
    out = {r.k: r.v for r in dedupe(df, ["k"], ["o"]).collect()}
    assert out == {1: "a", 2: "z"}


def test_new_rows_null_safe(spark):
    inc = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "a int, b string")
    ex = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert new_rows(inc, ex, ["a", "b"]).count() == 2          # NULL never equal
    assert [r.a for r in new_rows(inc, ex, ["a", "b"], null_safe=True).collect()] == [3]


def test_consecutive_ids_span_partitions(spark):
    df = spark.range(0, 1000).select(F.format_string("n%04d", "id").alias("name")).repartition(7)
    ids = consecutive_ids(df, ["name"], start=10, id_col="id", num_partitions=5)
    rows = sorted((r.name, r.id) for r in ids.collect())
    assert [i for _, i in rows] == list(range(10, 1010))


def test_assign_keys_from_empty_and_existing(spark):
    names = spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "team_name string")
    empty = spark.createDataFrame([], "team_id bigint, team_name string")
    lookup, new = assign_keys(names, empty, "team_name", "team_id", {"country": "Unknown"})
    assert sorted((r.team_name, r.team_id) for r in lookup.collect()) == [("a", 1), ("b", 2)]
    assert {r.country for r in new.collect()} == {"Unknown"}
    dim = spark.createDataFrame([(7, "a")], "team_id bigint, team_name string")
    lookup, new = assign_keys(names, dim, "team_name", "team_id")
    assert sorted((r.team_name, r.team_id) for r in lookup.collect()) == [("a", 7), ("b", 8)]
    assert new.count() == 1


def test_ensure_members(spark):
    facts = spark.createDataFrame([(1, "x"), (5, "y"), (5, "w"), (None, "z")], "player_id bigint, full_name string")
    dim = spark.createDataFrame([(1,)], "player_id bigint")
    out = ensure_members(facts, dim, "player_id", name_col="full_name", defaults={"country": "Unknown"}).collect()
    assert [(r.player_id, r.full_name, r.country) for r in out] == [(5, "w", "Unknown")]


def test_player_entries_bad_rows(spark):
    good, bad = docs(spark, "player_lists", [
        {"player": [{"id": "1", "name": "A"}, {"id": "", "name": "blank"}, {"name": "no id"}]},
        {"players": [{"id": 2, "name": "B", "role": "Batter"}], "rank": [{"id": "1", "name": "A2"}]},
        {"values": None},
        "this is not json",
    ])
    assert bad.count() == 1
    out = I.extract_players(I.collect_entries(good, ["player", "players", "rank", "values"]))
    rows = {r.player_id: r for r in out.collect()}
    assert set(rows) == {1, 2}
    assert rows[1].full_name == "A"          # duplicate id: first by name
    assert rows[2].playing_role == "Batter" and rows[2].bowling_style == ""
    assert rows[1].country == "Unknown"


def test_batting_and_bowling_lines(spark):
    good, _ = docs(spark, "scorecard", [{"matchId": "9", "scorecard": [
        {"batsman": [{"id": "3", "runs": "1,234", "balls": "10", "strkrate": "1,234.5", "outdec": "not out"},
                     {"id": "4", "runs": "abc", "strkrate": "abc", "outdec": "  "},
                     {"id": "", "runs": "5"}],
         "bowler": [{"id": "3", "overs": "4.2", "runs": "30", "wickets": "2", "econ": "7.1"},
                    {"id": "6"}]},
        {"batsman": None}]}])
    bat = {r.player_id: r for r in I.extract_batting(good).collect()}
    assert bat[3].runs_scored == 1234 and bat[3].strike_rate == 1234.5 and bat[3].is_out is True
    assert bat[3].batting_position == 1 and bat[4].batting_position == 2
    assert bat[4].runs_scored == 0 and bat[4].is_out is False and bat[4].format == "T20I"
    bowl = {r.player_id: r for r in I.extract_bowling(good).collect()}
    assert str(bowl[3].overs_bowled) == "4.2" and bowl[6].runs_conceded == 0


def test_player_match_guard(spark):
    good, _ = docs(spark, "player_matches", [{"playerId": "1", "matchBattingStatsList": [
        {"matchDate": "2024-01-02", "runs": "5", "ballsFaced": "8"},
        {"matchDate": "2024-01-03", "runs": "5", "ballsFaced": "0"},
        {"matchDate": "", "runs": "5", "ballsFaced": "2"},
        {"matchDate": "2024-01-04", "ballsFaced": "2"}]}])
    rows = I.extract_player_match(good).collect()
    assert len(rows) == 1 and rows[0].strike_rate == 62.5


def test_quarterly_rolls_up_months(spark):
    good, _ = docs(spark, "career", [{"playerId": "1", "stats": [{"format": "ODI", "timeline": [
        {"year": "2024", "month": "1", "runs": "10", "strikeRate": "100", "matches": "1"},
        {"year": "2024", "month": "2", "runs": "20", "strikeRate": "50", "matches": "3"},
        {"year": "2024", "month": "4", "runs": "5", "strikeRate": "80", "matches": "1"}]}]}])
    rows = {(r.year, r.quarter): r for r in I.extract_quarterly(good).collect()}
    assert rows[(2024, 1)].total_runs == 30 and rows[(2024, 1)].matches_played == 4
    assert float(rows[(2024, 1)].strike_rate) == 62.5
    assert rows[(2024, 2)].total_runs == 5


def test_format_summary_last_duplicate_wins(spark):
    bat, _ = docs(spark, "career", [{"playerId": "1", "stats": [
        {"format": "ODI", "runs": "10"}, {"format": "ODI", "runs": "99"}, {"runs": "7"}]}])
    bowl, _ = docs(spark, "career", [{"playerId": "1", "stats": [{"format": "Test", "wickets": "4"}]}])
    rows = {r.format: r for r in I.merge_format_summary(bat, bowl).collect()}
    assert rows["ODI"].total_runs == 99 and rows["ODI"].total_wickets == 0
    assert rows["Test"].total_runs == 0 and rows["Test"].total_wickets == 4


def test_read_documents_skip_and_fail(spark, tmpdir_path):
    path = f"{tmpdir_path}/docs.json"
    with open(path, "w") as fh:
        fh.write('{"list": [{"teamId": "1", "teamName": "X"}]}\n{broken\n')
    good, bad = read_documents(spark, path, doc_schema("team_list"))
    assert good.count() == 1 and bad.count() == 1
    teams = I.extract_teams(good).collect()
    assert teams[0].country == "X"       # falls back to the team name
    failing, _ = read_documents(spark, path, doc_schema("team_list"), on_error="fail")
    try:
        failing.collect()
        raise AssertionError("expected a parse failure")
    except Exception as e:  # noqa: BLE001
        assert "MALFORMED" in str(e) or "Malformed" in str(e)


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "12x")], "id int, v string")
    assert sorted((r.id, r.row_count) for r in check_unique(df, ["id"]).collect()
                  if r.id is not None) == [(1, 2)]
    dim = spark.createDataFrame([(1,)], "id int")
    assert [r.id for r in check_reference(df, "id", dim, "id").collect()] == [2]
    assert [r.v for r in check_castable(df, "v", "int").collect()] == ["a", "b", "c", "12x"]


def test_apply_changes(spark):
    base = spark.createDataFrame([(1, "A", "X"), (2, "B", "Y"), (3, "C", "Z")],
                                 "player_id bigint, full_name string, country string")
    ch = spark.createDataFrame([
        ("I", 1, 4, " D ", " W "), ("I", 2, 1, "dup", "dup"), ("I", 3, 5, "  ", "W"),
        ("U", 4, 2, None, "Y2"), ("U", 5, 9, None, "none"), ("D", 6, 3, None, None), ("D", 7, 8, None, None),
        ("U", 8, 4, None, "W2")],
        "op string, seq bigint, player_id bigint, full_name string, country string")
    out, rejected = apply_changes(base, ch, ["player_id"])
    rows = {r.player_id: (r.full_name, r.country) for r in out.collect()}
    assert rows == {1: ("A", "X"), 2: ("B", "Y2"), 4: ("D", "W2")}
    assert {(r.player_id, r.reason) for r in rejected.collect()} == {(1, "duplicate key"), (5, "invalid row")}
    ch2 = ch.where("seq <> 8")
    once, _ = apply_changes(base, ch2, ["player_id"])
    twice, _ = apply_changes(once, ch2, ["player_id"])
    assert sorted(once.collect()) == sorted(twice.collect()) and once.count() == 3


@pytest.mark.parametrize("ops, there, want, reasons", [
    ("IU", False, ("u", "i"), []), ("DI", True, ("i", "i"), []), ("UI", True, ("u", "c"), ["duplicate key"]),
    ("DU", True, None, []), ("IDIUI", False, ("u", "i"), ["duplicate key"]), ("ID", False, None, []),
    ("IDDI", True, ("i", "i"), ["duplicate key"])])
def test_changes_of_a_key_act_in_order(spark, ops, there, want, reasons):
    base = spark.createDataFrame([(7, "t", "c")] if there else [], "player_id bigint, full_name string, country string")
    value = {"I": ("i", "i"), "U": ("u", None), "D": (None, None)}
    ch = spark.createDataFrame([(op, k, 7, *value[op]) for k, op in enumerate(ops)],
                               "op string, seq bigint, player_id bigint, full_name string, country string")
    out, rejected = apply_changes(base, ch, ["player_id"])
    assert [tuple(r)[1:] for r in out.collect()] == ([want] if want else [])
    assert [r.reason for r in rejected.collect()] == reasons


def test_hot_key_is_folded_in_parts(spark):
    from crease.operators.changes import fold_changes
    base = spark.createDataFrame([(1, "t", "c"), (2, "t", "c")], "player_id bigint, full_name string, country string")
    n = 3000
    ch = spark.range(n).selectExpr(
        "element_at(array('I', 'U', 'D', 'U', 'I'), cast(id % 5 as int) + 1) op", "id seq",
        "if(id % 3 = 0, id, 1) player_id", "concat('n', id) full_name", "if(id % 2 = 0, concat('c', id), null) country")
    rows = {r.seq: r for r in ch.collect()}
    table, bad = {1: ("t", "c"), 2: ("t", "c")}, 0
    for k in range(n):
        r = rows[k]
        if r.op == "D":
            table.pop(r.player_id, None)
        elif r.op == "U" and r.player_id in table:
            table[r.player_id] = (r.full_name, r.country or table[r.player_id][1])
        elif r.op == "I" and (r.player_id in table or not r.country or not r.player_id):
            bad += 1
        elif r.op == "I":
            table[r.player_id] = (r.full_name, r.country)
    out, rejected = apply_changes(base, ch, ["player_id"])
    assert {r.player_id: (r.full_name, r.country) for r in out.collect()} == table
    assert rejected.count() == bad
    told, _ = fold_changes(base, ch, ["player_id"])
    assert told.where("player_id = 1").select("_part").distinct().count() > 2


def test_players_keep_first_in_document_order(spark):
    rows = [(json.dumps({"players": [{"id": "1", "name": "Zed"}]}),),
            (json.dumps({"player": [{"id": "2", "name": "Q"}], "rank": [{"id": "1", "name": "Abe"}]}),)]
    df = spark.createDataFrame(rows, "value string").coalesce(1)
    good, _ = parse_documents(df, "value", doc_schema("player_lists"), with_order=True)
    out = {r.player_id: r.full_name for r in I.extract_players(I.collect_entries(good, ["player", "players", "rank"])).collect()}
    assert out == {1: "Zed", 2: "Q"}      # first occurrence wins, not the smallest name


def test_not_out_values_option(spark):
    good, _ = docs(spark, "scorecard", [{"matchId": "1", "scorecard": [{"batsman": [
        {"id": "1", "outdec": "not out"}, {"id": "2", "outdec": "c X b Y"}, {"id": "3", "outdec": " Not Out "}]}]}])
    default = {r.player_id: r.is_out for r in I.extract_batting(good).collect()}
    assert default == {1: True, 2: True, 3: True}          # the source's rule: any text counts as out
    opt = {r.player_id: r.is_out for r in I.extract_batting(good, not_out_values=["not out"]).collect()}
    assert opt == {1: False, 2: True, 3: False}


def test_player_match_rate_rounds_like_python(spark):
    good, _ = docs(spark, "player_matches", [{"playerId": "1", "matchBattingStatsList": [
        {"matchDate": "2024-01-0%d" % (i + 1), "runs": str(r), "ballsFaced": str(b)}
        for i, (r, b) in enumerate([(1, 32), (107, 40), (1, 3), (2, 3)])]}])
    got = sorted(r.strike_rate for r in I.extract_player_match(good).collect())
    assert got == sorted(round((r / b) * 100, 2) for r, b in [(1, 32), (107, 40), (1, 3), (2, 3)])
