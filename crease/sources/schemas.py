"""Target table schemas and source document schemas (§1.4).

Tables use explicit `StructType`s so scans never infer.  Surrogate and natural
ids are BIGINT so they hold at any scale.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

# Target tables, T1-T13.  `runouts` is kept on fielding_stats.  The four tables of
# scorecard lines also keep a line's place (innings, line): the source inserts a row per line, and
# a player may have equal lines in two innings of one match.
TABLE_DDL: dict[str, str] = {
    "players": "player_id bigint, full_name string, country string, playing_role string, "
               "batting_style string, bowling_style string",
    "teams": "team_id bigint, team_name string, country string",
    "venues": "venue_id bigint, venue_name string, city string, country string, capacity int",
    "series": "series_id bigint, series_name string, host_country string, match_type string, "
              "start_date date, total_matches int",
    "matches": "match_id bigint, match_description string, match_date date, match_status string, "
               "team1_id bigint, team2_id bigint, winning_team string, victory_margin int, "
               "victory_type string, venue_id bigint, toss_winner string, toss_decision string",
    "batting_stats": "stat_id bigint, player_id bigint, match_id bigint, format string, "
                     "runs_scored int, balls_faced int, strike_rate double, batting_position int, "
                     "is_out boolean, innings_number int",
    "bowling_stats": "stat_id bigint, player_id bigint, match_id bigint, format string, "
                     "overs_bowled decimal(4,1), runs_conceded int, wickets_taken int, "
                     "economy_rate decimal(4,2), innings_number int, line_number int",
    "player_match": "player_id bigint, match_date date, runs_scored int, strike_rate decimal(5,2)",
    "fielding_stats": "stat_id bigint, player_id bigint, match_id bigint, catches int, "
                      "stumpings int, runouts int, innings_number int, line_number int",
    "batting_partnerships": "partnership_id bigint, match_id bigint, innings_number int, "
                            "player1_id bigint, player2_id bigint, batting_position1 int, "
                            "batting_position2 int, partnership_runs int",
    "player_format_summary": "player_id bigint, format string, total_runs int, total_wickets int, "
                             "batting_average decimal(5,2), bowling_average decimal(5,2), "
                             "strike_rate decimal(5,2), economy_rate decimal(5,2), centuries int, "
                             "matches_played int, innings_played int",
    "player_quarterly_stats": "player_id bigint, year int, quarter int, format string, "
                              "total_runs int, strike_rate decimal(5,2), matches_played int",
    "player_recent_form": "player_id bigint, match_id bigint, runs_scored int, balls_faced int, "
                          "strike_rate decimal(5,2), is_above_50 boolean, match_date date, "
                          "innings_number int, line_number int",
}

# Declared keys: used by the constraint checks C1/C2.
PRIMARY_KEYS: dict[str, list[str]] = {
    "players": ["player_id"],
    "teams": ["team_id"],
    "venues": ["venue_id"],
    "series": ["series_id"],
    "matches": ["match_id"],
    "batting_stats": ["stat_id"],
    "bowling_stats": ["stat_id"],
    "fielding_stats": ["stat_id"],
    "batting_partnerships": ["partnership_id"],
    "player_format_summary": ["player_id", "format"],
    "player_quarterly_stats": ["player_id", "year", "quarter", "format"],
}

# (table, column) -> (dimension table, key)
FOREIGN_KEYS: dict[str, list[tuple[str, str, str]]] = {
    "matches": [("team1_id", "teams", "team_id"), ("team2_id", "teams", "team_id"),
                ("venue_id", "venues", "venue_id")],
    "batting_stats": [("player_id", "players", "player_id"), ("match_id", "matches", "match_id")],
    "bowling_stats": [("player_id", "players", "player_id"), ("match_id", "matches", "match_id")],
    "fielding_stats": [("player_id", "players", "player_id"), ("match_id", "matches", "match_id")],
    "batting_partnerships": [("match_id", "matches", "match_id"),
                             ("player1_id", "players", "player_id"),
                             ("player2_id", "players", "player_id")],
    "player_format_summary": [("player_id", "players", "player_id")],
    "player_quarterly_stats": [("player_id", "players", "player_id")],
    "player_recent_form": [("player_id", "players", "player_id"), ("match_id", "matches", "match_id")],
}

# Declared text widths, VARCHAR(n) (used by check_types).
VARCHAR_WIDTHS: dict[str, dict[str, int]] = {
    "players": {"full_name": 100, "country": 50, "playing_role": 30, "batting_style": 30,
                "bowling_style": 50},
    "teams": {"team_name": 100, "country": 50},
    "venues": {"venue_name": 100, "city": 50, "country": 50},
    "series": {"series_name": 100, "host_country": 50, "match_type": 20},
    "matches": {"match_description": 200, "match_status": 20, "winning_team": 100,
                "victory_type": 10, "toss_winner": 100, "toss_decision": 10},
    "batting_stats": {"format": 10},
    "bowling_stats": {"format": 10},
    "player_format_summary": {"format": 10},
    "player_quarterly_stats": {"format": 10},
}


def table_schema(name: str) -> StructType:
    return StructType.fromDDL(TABLE_DDL[name])


# ---------------------------------------------------------------------------
# Source documents.  Leaves are strings so mixed number / numeric-text input
# parses the same way; operators convert with try_cast.
# ---------------------------------------------------------------------------

_PLAYER_ENTRY = "struct<id:string,name:string,role:string,battingStyle:string,bowlingStyle:string," \
                "teamName:string,country:string,rating:string,rank:string>"

DOC_DDL: dict[str, str] = {
    # J1 player lists under any of four keys
    "player_lists": f"player array<{_PLAYER_ENTRY}>, players array<{_PLAYER_ENTRY}>, "
                    f"rank array<{_PLAYER_ENTRY}>, `values` array<{_PLAYER_ENTRY}>, country string",
    # J2
    "team_list": "list array<struct<teamId:string,teamName:string,countryName:string>>",
    # J3
    "series_venues": "seriesVenue array<struct<ground:string,city:string,country:string>>",
    # J4 + J5: both match-list shapes in one schema
    "match_list": (
        "typeMatches array<struct<matchType:string,seriesMatches:array<struct<"
        "matches:array<struct<venue:struct<name:string,city:string,country:string>>>,"
        "seriesAdWrapper:struct<seriesId:string,seriesName:string,matches:array<struct<matchInfo:struct<"
        "matchId:string,matchDesc:string,startDate:string,status:string,stateTitle:string,"
        "matchFormat:string,seriesName:string,team1:struct<teamId:string,teamName:string>,"
        "team2:struct<teamId:string,teamName:string>,"
        "tossResults:struct<tossWinner:string,decision:string>,matchWinner:string,"
        "venueInfo:struct<ground:string,city:string,country:string>,"
        "matchScore:struct<margin:struct<value:string,type:string>,"
        "team1Score:struct<inngs1:struct<runs:string,wickets:string,overs:string>>,"
        "team2Score:struct<inngs1:struct<runs:string,wickets:string,overs:string>>>"
        ">>>>>>>>"
    ),
    # J6 innings scorecard
    "scorecard": (
        "matchId string, format string, scorecard array<struct<inningsId:string,"
        "batsman:array<struct<id:string,name:string,runs:string,balls:string,strkrate:string,outdec:string>>,"
        "bowler:array<struct<id:string,name:string,overs:string,runs:string,wickets:string,econ:string>>>>"
    ),
    # J7 player match list
    "player_matches": "playerId string, matchBattingStatsList array<struct<matchDate:string,"
                      "runs:string,ballsFaced:string>>",
    # J8 detailed scorecard
    "detailed_scorecard": (
        "matchId string, matchHeader struct<startDate:string>, innings array<struct<inningsId:string,"
        "batting:struct<batters:array<struct<id:string,runs:string,balls:string,strikeRate:string>>>,"
        "fielding:struct<players:array<struct<id:string,catches:string,stumpings:string,runouts:string>>>,"
        "partnerships:array<struct<batsmen:array<struct<id:string,position:string>>,runs:string>>>>"
    ),
    # J9 career stats: one batting and one bowling document per player
    "career": (
        "playerId string, kind string, stats array<struct<format:string,runs:string,wickets:string,"
        "average:string,strikeRate:string,economyRate:string,hundreds:string,matches:string,"
        "innings:string,timeline:array<struct<year:string,month:string,runs:string,"
        "strikeRate:string,matches:string>>>>"
    ),
    # J10 stat matrix
    "stat_matrix": "playerId string, headers array<string>, `values` array<struct<`values`:array<string>>>",
    # J11 rankings
    "rankings": "formatType string, rank array<struct<id:string,name:string,country:string,rating:string>>",
    # J12 news
    "news": "playerId string, storyList array<struct<story:struct<hline:string,context:string,"
            "pubTime:string,intro:string,coverImage:struct<caption:string>>>>",
    # J13 squad (both forms)
    "squad": "matchId string, team array<struct<players:array<struct<name:string,playingRole:string>>>>, "
             "players struct<`playing XI`:array<string>,bench:array<string>>",
}


def doc_schema(name: str) -> StructType:
    return StructType.fromDDL(DOC_DDL[name])
