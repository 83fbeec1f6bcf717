"""Dashboard data products as tables.

The source renders these on screen from API responses; here they are plain
DataFrames built from parsed documents or stored tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crease.functions.semantics import epoch_ms_to_text, parse_long
from crease.operators.ingest import flatten_match_list

# Fixed display values of the source's data products.
DASH = "–"
NOT_AVAILABLE = "N/A"
START_FORMAT = "dd MMM yyyy hh:mm a"
NEWS_DATE_FORMAT = "dd MMM yyyy"
SQUAD_GROUPS = (("playing XI", "xi"), ("bench", "bench"))
RANKINGS_SHOWN = 15


def _or_dash(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(DASH))


def _score(prefix: str) -> Column:
    s = f"info.matchScore.{prefix}.inngs1"
    return F.concat(_or_dash(F.col(f"{s}.runs")), F.lit("/"), _or_dash(F.col(f"{s}.wickets")),
                    F.lit(" in "), _or_dash(F.col(f"{s}.overs")), F.lit(" overs"))


def match_board(docs: DataFrame) -> DataFrame:
    """B1: one row per match with label, scores and formatted start time."""
    m = flatten_match_list(docs, wrapped=True)
    t1, t2 = _or_dash(F.col("info.team1.teamName")), _or_dash(F.col("info.team2.teamName"))
    start = F.when(F.coalesce(F.col("info.startDate"), F.lit("")) == "", F.lit(NOT_AVAILABLE)) \
        .otherwise(epoch_ms_to_text("info.startDate", START_FORMAT, NOT_AVAILABLE))
    return m.select(
        F.concat(t1, F.lit(" vs "), t2, F.lit(" ("), _or_dash(F.col("series_name")), F.lit(")")).alias("label"),
        F.col("info.seriesName").alias("Series"),
        F.concat(t1, F.lit(" vs "), t2).alias("Match"),
        F.col("info.matchDesc").alias("Description"),
        F.col("info.matchFormat").alias("Format"),
        F.col("info.status").alias("Status"),
        F.col("info.stateTitle").alias("Result"),
        F.concat(_or_dash(F.col("info.venueInfo.ground")), F.lit(", "), _or_dash(F.col("info.venueInfo.city")))
        .alias("Venue"),
        start.alias("Start Date"),
        _score("team1Score").alias("Team 1 Score"),
        _score("team2Score").alias("Team 2 Score"),
        parse_long("info.matchId").alias("matchId"))


def squads(docs: DataFrame) -> DataFrame:
    """B2: (matchId, group, name) for playing XI and bench.

    Reads both squad shapes: `team[].players[]{name, playingRole}`, grouped by
    a case-folded substring of the role, and `players{"playing XI": [...],
    "bench": [...]}`.
    """
    return _squad_rows(docs).select("matchId", "group", "name")


def _squad_rows(docs: DataFrame) -> DataFrame:
    """`squads` with each name's place (`at`) in its document."""
    mid = parse_long("matchId").alias("matchId")
    t = docs.select(mid, F.posexplode(F.coalesce(F.col("team"), F.array())).alias("_t", "t"))
    p = t.select("matchId", "_t", F.posexplode(F.coalesce(F.col("t.players"), F.array())).alias("_p", "p"))
    role = F.lower(F.coalesce(F.col("p.playingRole"), F.lit("")))
    grp = None
    for name, needle in SQUAD_GROUPS:
        grp = F.when(role.contains(needle), name) if grp is None else grp.when(role.contains(needle), name)
    rows = p.select("matchId", grp.alias("group"), F.struct("_t", "_p").alias("at"),
                    F.coalesce(F.col("p.name"), F.lit("Unknown")).alias("name")).where(F.col("group").isNotNull())
    for name, _ in SQUAD_GROUPS:
        part = docs.select(mid, F.lit(name).alias("group"),
                           F.posexplode(F.coalesce(F.col(f"players.`{name}`"), F.array())).alias("_p", "name"))
        rows = rows.unionByName(part.select("matchId", "group", F.struct(F.lit(-1).alias("_t"), "_p").alias("at"),
                                            "name"))
    return rows


def squad_lists(docs: DataFrame) -> DataFrame:
    """B2 grouped: one row per (matchId, group) with the names in document order."""
    listed = _squad_rows(docs).groupBy("matchId", "group").agg(F.sort_array(F.collect_list(F.struct("at", "name")))
                                                               .alias("x"))
    return listed.select("matchId", "group", F.col("x.name").alias("names"))


def _ranked(docs: DataFrame, fmt: str) -> DataFrame:
    r = docs.where(F.col("formatType") == fmt).select(F.posexplode(F.coalesce(F.col("rank"), F.array())).alias("_p", "r"))
    return r.select((F.col("_p") + 1).alias("position"), parse_long("r.id").alias("id"), F.col("r.name").alias("name"),
                    F.col("r.country").alias("country"), F.col("r.rating").try_cast("double").alias("rating"))


def rankings(docs: DataFrame, fmt: str, k: int = RANKINGS_SHOWN) -> DataFrame:
    """Top-k ranked players of one format (rating desc, id as tie-break)."""
    return _ranked(docs, fmt).drop("position").orderBy(F.col("rating").desc_nulls_last(), F.col("id").asc()).limit(k)


def ranking_list(docs: DataFrame, fmt: str, k: int = RANKINGS_SHOWN) -> DataFrame:
    """B3 as listed: the first k entries of one format's ordered list, with their position in it."""
    return _ranked(docs, fmt).where(F.col("position") <= k).orderBy("position", "id")


def stat_matrix(docs: DataFrame) -> DataFrame:
    """`headers[]` + `values[].values[]` -> long rows (playerId, row_no, col_no, header, value)."""
    rows = docs.select(parse_long("playerId").alias("playerId"), "headers",
                       F.posexplode(F.coalesce(F.col("values"), F.array())).alias("row_no", "v"))
    cells = rows.select("playerId", (F.col("row_no") + 1).alias("row_no"), "headers",
                        F.posexplode(F.coalesce(F.col("v.values"), F.array())).alias("col_no", "value"))
    return cells.select("playerId", "row_no", (F.col("col_no") + 1).alias("col_no"),
                        F.try_element_at("headers", (F.col("col_no") + 1).cast("int")).alias("header"), "value") \
        .where(F.col("header").isNotNull())


def stat_matrix_wide(docs: DataFrame, headers: Sequence[str]) -> DataFrame:
    """B4 as a table: one column per header (explicit pivot values, no discovery pass)."""
    return (stat_matrix(docs).groupBy("playerId", "row_no")
            .pivot("header", list(headers)).agg(F.first("value")))


def news_feed(docs: DataFrame) -> DataFrame:
    """Non-empty stories with a formatted publication date ('–' when unreadable)."""
    s = docs.select(parse_long("playerId").alias("playerId"),
                    F.explode(F.coalesce(F.col("storyList"), F.array())).alias("item"))
    s = s.where(F.col("item.story").isNotNull()).select("playerId", "item.story.*")
    return s.select("playerId", F.col("hline").alias("headline"),
                    F.coalesce(F.col("context"), F.lit("")).alias("context"),
                    epoch_ms_to_text("pubTime", NEWS_DATE_FORMAT, DASH).alias("published"),
                    F.coalesce(F.col("intro"), F.lit("")).alias("intro"),
                    F.col("coverImage.caption").alias("caption"))


def player_label(name: Column, team: Column) -> Column:
    """'<name> (<team>)', the option label of a player."""
    return F.concat(_or_dash(name), F.lit(" ("), _or_dash(team), F.lit(")"))


def player_search(players: DataFrame, text: str, name_col: str = "full_name", team_col: str = "country") -> DataFrame:
    """Case-insensitive substring search on the name, with option labels."""
    return (players.where(F.lower(F.col(name_col)).contains(text.lower()))
            .select("player_id", name_col, team_col,
                    player_label(F.col(name_col), F.col(team_col)).alias("label")))


def player_by_label(players: DataFrame, label: Column | str, name_col: str = "full_name",
                    team_col: str = "country") -> DataFrame:
    """The first player (lowest id) whose label equals `label`."""
    lab = label if isinstance(label, Column) else F.lit(label)
    return (players.where(player_label(F.col(name_col), F.col(team_col)) == lab)
            .orderBy("player_id").limit(1))
