"""Ingest operators: nested documents -> target table rows.

Every extractor takes a DataFrame of parsed documents (see
`crease.sources.documents`) and returns flat rows; nothing loops in Python.
Missing keys and JSON nulls both take the source's default (SURVEY 8.10).
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crease.functions.semantics import (
    epoch_ms_to_date, month_to_quarter, non_blank, parse_decimal, parse_double, parse_int,
    parse_long, round_dec, round_float, text_or, unreadable,
)
from crease.operators.keys import assign_keys, dedupe, dedupe_all, ensure_members, fresh_rows, met_rows, new_rows
from crease.operators.upsert import DEFAULT_PARTS, in_parts, upsert_rows
from crease.sources.documents import DOC_ORDER
from crease.session import delete_folder, is_small
from crease.sources.sinks import LoadReport, append_rows, faulty_lines, keep_rejects, stage_lines
from crease.sources.tables import load_table, path_exists

UNKNOWN = "Unknown"
DEFAULT_FORMAT = "T20I"


# ---------------------------------------------------------------------------
# Probing several keys
# ---------------------------------------------------------------------------

ENTRY_POS = "_entry_pos"
LIST_POS = "_list_pos"


def collect_entries(docs: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Entries found under *any* of `keys` (array fields of the same element type).

    Concatenates the arrays present (missing -> empty) in `keys` order and
    explodes them once; `_entry_pos` is the entry's position in that
    concatenation, and a `_doc_order` column of the documents is carried along.
    """
    keep = list(keep)
    if DOC_ORDER in docs.columns and DOC_ORDER not in keep:
        keep.append(DOC_ORDER)
    arrays = [F.coalesce(F.col(f"`{k}`"), F.array()) for k in keys]
    allv = F.flatten(F.array(*arrays)) if len(arrays) > 1 else arrays[0]
    return docs.select(*keep, F.posexplode(allv).alias(ENTRY_POS, "entry")).select(*keep, ENTRY_POS, "entry.*")


def first_present(*cols: str | Column) -> Column:
    """Value of the first key present."""
    return F.coalesce(*[F.col(c) if isinstance(c, str) else c for c in cols])


# ---------------------------------------------------------------------------
# Players, teams, venues
# ---------------------------------------------------------------------------

def extract_players(entries: DataFrame, country: str | Column = UNKNOWN) -> DataFrame:
    """Entries {id, name, role, battingStyle, bowlingStyle} -> players rows.

    Entries without an id (missing, NULL or empty text) are dropped; text
    fields default to ''.  One row per player_id (I7): the first occurrence in
    document order when the entries carry it (`_doc_order`, `_entry_pos`),
    otherwise the smallest by name.
    """
    ctry = country if isinstance(country, Column) else F.lit(country)
    order = [c for c in (DOC_ORDER, ENTRY_POS) if c in entries.columns]
    rows = (entries.where(non_blank(F.col("id")))
            .select(parse_long("id").alias("player_id"),
                    text_or("name").alias("full_name"),
                    ctry.alias("country"),
                    text_or("role").alias("playing_role"),
                    text_or("battingStyle").alias("batting_style"),
                    text_or("bowlingStyle").alias("bowling_style"),
                    *[F.col(c) for c in order])
            .where(F.col("player_id").isNotNull()))
    values = ["full_name", "playing_role", "batting_style", "bowling_style", "country"]
    return dedupe(rows, ["player_id"], order + values).select("player_id", *values)


def extract_teams(docs: DataFrame) -> DataFrame:
    """I4: team list -> teams rows; country falls back to the team name."""
    t = docs.select(F.explode(F.coalesce(F.col("list"), F.array())).alias("t")).select("t.*")
    rows = (t.where(non_blank(F.col("teamId")))
            .select(parse_long("teamId").alias("team_id"),
                    text_or("teamName").alias("team_name"),
                    F.coalesce(F.col("countryName"), F.col("teamName"), F.lit("")).alias("country"))
            .where(F.col("team_id").isNotNull()))
    return dedupe(rows, ["team_id"], ["team_name", "country"])


def extract_venues(series_docs: DataFrame | None = None, match_docs: DataFrame | None = None) -> DataFrame:
    """Venues from series venue lists and flat match lists; capacity unknown.

    Rows are distinct on (venue_name, city, country).  Venue ids are assigned
    later (I9), the source's bulk load leaves them out (SURVEY D3).
    """
    parts = []
    if series_docs is not None:
        v = series_docs.select(F.explode(F.coalesce(F.col("seriesVenue"), F.array())).alias("v"))
        parts.append(v.select(text_or("v.ground").alias("venue_name"), text_or("v.city").alias("city"),
                              text_or("v.country").alias("country")))
    if match_docs is not None:
        m = flatten_match_list(match_docs, wrapped=False)
        m = m.where(non_blank(F.col("venue.name")))
        parts.append(m.select(text_or("venue.name").alias("venue_name"), text_or("venue.city").alias("city"),
                              text_or("venue.country").alias("country")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct().withColumn("capacity", F.lit(None).cast("int"))


# ---------------------------------------------------------------------------
# Match lists
# ---------------------------------------------------------------------------

def flatten_match_list(docs: DataFrame, wrapped: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """typeMatches[] -> seriesMatches[] -> matches[] as one row per match.

    `wrapped=True` reads the `seriesAdWrapper.matches[].matchInfo` shape,
    `False` the flat `matches[]` shape (SURVEY D7).
    `_list_pos` is the match's position in the document (type, series and
    match index), for first-occurrence rules.
    """
    keep = list(keep)
    if DOC_ORDER in docs.columns and DOC_ORDER not in keep:
        keep.append(DOC_ORDER)
    t = docs.select(*keep, F.posexplode(F.coalesce(F.col("typeMatches"), F.array())).alias("_t", "tm"))
    s = t.select(*keep, "_t", F.col("tm.matchType").alias("match_type"),
                 F.posexplode(F.coalesce(F.col("tm.seriesMatches"), F.array())).alias("_s", "sm"))
    if wrapped:
        m = s.select(*keep, "_t", "_s", "match_type", F.col("sm.seriesAdWrapper.seriesName").alias("series_name"),
                     F.posexplode(F.coalesce(F.col("sm.seriesAdWrapper.matches"), F.array())).alias("_m", "mm"))
        return m.where(F.col("mm.matchInfo").isNotNull()) \
            .select(*keep, F.struct("_t", "_s", "_m").alias(LIST_POS), "match_type", "series_name",
                    F.col("mm.matchInfo").alias("info"))
    m = s.select(*keep, "_t", "_s", "match_type",
                 F.posexplode(F.coalesce(F.col("sm.matches"), F.array())).alias("_m", "mm"))
    return m.select(*keep, F.struct("_t", "_s", "_m").alias(LIST_POS), "match_type", "mm.*")


def extract_matches(docs: DataFrame, teams: DataFrame, venues: DataFrame,
                    existing: DataFrame | None = None, stage_dir: str | None = None) -> dict[str, DataFrame]:
    """Wrapped match lists -> matches rows, creating missing teams / venues.

    Returns {"matches", "new_teams", "new_venues", "duplicates"}.  Team and
    venue names resolve through get-or-create keys (I9): unknown teams get
    country 'Unknown', unknown venues city/country 'Unknown' and capacity 0.
    A match_id already stored in `existing` (or repeated in the input) is
    reported in "duplicates" and skipped; the rest load.

    The outputs read the flattened rows several times (key numbering needs a
    sampling pass and a count pass).  With `stage_dir` (a folder in the
    cluster's shared checkpoint area) the rows are written there once and
    every pass reads that compact Parquet instead of re-parsing documents.
    """
    flat = flatten_match_list(docs, wrapped=True)
    order_cols = [c for c in (DOC_ORDER, LIST_POS) if c in flat.columns]
    info = flat.select(*order_cols, "info.*")
    rows = info.select(
        *order_cols,
        F.coalesce(parse_long("matchId"), F.lit(0)).alias("match_id"),
        text_or("matchDesc").alias("match_description"),
        epoch_ms_to_date(F.coalesce(F.col("startDate"), F.lit("0"))).alias("match_date"),
        text_or("status").alias("match_status"),
        text_or("team1.teamName").alias("team1_name"),
        text_or("team2.teamName").alias("team2_name"),
        text_or("matchWinner").alias("winning_team"),
        parse_int("matchScore.margin.value").alias("victory_margin"),
        F.col("matchScore.margin.type").alias("victory_type"),
        text_or("venueInfo.ground").alias("venue_name"),
        text_or("tossResults.tossWinner").alias("toss_winner"),
        text_or("tossResults.decision").alias("toss_decision"))
    if stage_dir:
        path = f"{stage_dir.rstrip('/')}/matches_flat"
        rows.write.mode("overwrite").parquet(path)
        rows = rows.sparkSession.read.parquet(path)
    names = rows.select(F.col("team1_name").alias("team_name")).unionByName(
        rows.select(F.col("team2_name").alias("team_name")))
    team_ids, new_teams = assign_keys(names, teams, "team_name", "team_id", {"country": UNKNOWN})
    venue_ids, new_venues = assign_keys(rows.select("venue_name"), venues, "venue_name", "venue_id",
                                        {"city": UNKNOWN, "country": UNKNOWN, "capacity": 0})
    t1 = team_ids.select(F.col("team_name").alias("team1_name"), F.col("team_id").alias("team1_id"))
    t2 = team_ids.select(F.col("team_name").alias("team2_name"), F.col("team_id").alias("team2_id"))
    resolved = (rows.join(t1, "team1_name", "left").join(t2, "team2_name", "left")
                .join(venue_ids, "venue_name", "left"))
    cols = ["match_id", "match_description", "match_date", "match_status", "team1_id", "team2_id",
            "winning_team", "victory_margin", "victory_type", "venue_id", "toss_winner", "toss_decision"]
    # one row per match id: the first occurrence when the document order is
    # known (as the source's first insert wins), then by value; later ones are
    # reported as duplicates
    ordered = resolved.select(*order_cols, *cols)
    values = [c for c in cols if c != "match_id"]
    unique = dedupe(ordered, ["match_id"], order_cols + values).select(*cols)
    resolved = resolved.select(*cols)
    dup_ids = resolved.groupBy("match_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out = unique
    if existing is not None:
        stored = existing.select("match_id").distinct()
        dup_ids = dup_ids.select("match_id").unionByName(unique.join(stored, "match_id").select("match_id"))
        out = new_rows(unique, stored, ["match_id"])
    return {"matches": out, "new_teams": new_teams.select("team_id", "team_name", "country"),
            "new_venues": new_venues.select("venue_id", "venue_name", "city", "country", "capacity"),
            "duplicates": dup_ids.select("match_id").distinct()}


# ---------------------------------------------------------------------------
# Innings scorecards
# ---------------------------------------------------------------------------

FAULT = "fault"


def read_fields(rows: DataFrame, plain: Sequence[Column], numbers: dict[str, tuple], with_faults: bool) -> DataFrame:
    """Rows of plain columns and parsed numbers.

    `numbers` maps an output name to (raw text, parsed value, default, or None
    for no default).  A missing or blank field takes the default, and so does
    text that does not parse.  `with_faults=True` adds the names of the fields
    with such text in `fault` ('' when there is none): loads reject and count
    those rows instead of storing them.
    """
    values = [(parsed if default is None else F.coalesce(parsed, default)).alias(n)
              for n, (_, parsed, default) in numbers.items()]
    bad = [F.when(unreadable(raw, parsed), F.lit(n)) for n, (raw, parsed, _) in numbers.items()]
    return rows.select(*plain, *values, *([F.concat_ws(",", *bad).alias(FAULT)] if with_faults else []))


def _number(raw: str, parse=parse_int, default=0) -> tuple:
    return F.col(raw), parse(raw), None if default is None else F.lit(default)


def _decimal(raw: str, precision: int, scale: int) -> tuple:
    return (F.col(raw), parse_decimal(raw, precision, scale),
            F.lit(0).cast(f"decimal({precision},{scale})"))


def _innings(docs: DataFrame, match_id: str | None) -> DataFrame:
    return docs.select(F.col(match_id or "matchId").cast("string").alias("_match"),
                       F.col("format").alias("_doc_format") if "format" in docs.columns
                       else F.lit(None).cast("string").alias("_doc_format"),
                       F.posexplode(F.coalesce(F.col("scorecard"), F.array())).alias("_inn", "inn"))


def _line_numbers(position: str = "pos") -> list[Column]:
    """1-based place of the innings in its document, and of the line in its innings."""
    return [(F.col("_inn") + 1).cast("int").alias("innings_number"),
            (F.col(position) + 1).cast("int").alias("line_number")]


def extract_batting(docs: DataFrame, fmt: str = DEFAULT_FORMAT, match_id: str | None = None,
                    not_out_values: Sequence[str] = (), with_faults: bool = False) -> DataFrame:
    """Batsman lines -> batting_stats rows, one per line of every innings.

    Position is the 1-based order within the innings list; the strike rate
    loses thousands separators; `is_out` is true for any non-blank dismissal
    text (SURVEY D10); pass e.g. `not_out_values=("not out",)` to treat those
    texts (compared trimmed, case-folded) as not out.  The format comes from
    the document when it has one, else `fmt` (the source stamps every row
    'T20I', D11).  Missing numbers are 0; unreadable ones too, or marked
    (`read_fields`).
    """
    out_text = F.col("b.outdec")
    is_out = non_blank(out_text)
    if not_out_values:
        is_out = is_out & ~F.lower(F.trim(out_text)).isin([v.strip().lower() for v in not_out_values])
    inn = _innings(docs, match_id)
    b = inn.select("_match", "_doc_format", "_inn", F.posexplode(F.coalesce(F.col("inn.batsman"), F.array()))
                   .alias("pos", "b"))
    innings, position = _line_numbers()
    return read_fields(
        b.where(non_blank(F.col("b.id"))),
        [F.coalesce(F.col("_doc_format"), F.lit(fmt)).alias("format"), innings, position.alias("batting_position"),
         is_out.alias("is_out"), text_or("b.name", UNKNOWN).alias("name")],
        {"player_id": _number("b.id", parse_long, None), "match_id": _number("_match", parse_long, None),
         "runs_scored": _number("b.runs"), "balls_faced": _number("b.balls"),
         "strike_rate": _number("b.strkrate", parse_double, 0.0)}, with_faults)


def extract_bowling(docs: DataFrame, fmt: str = DEFAULT_FORMAT, match_id: str | None = None,
                    with_faults: bool = False) -> DataFrame:
    """Bowler lines -> bowling_stats rows, one per line of every innings.

    Numbers lose thousands separators; a rate that does not fit its column is unreadable.
    """
    inn = _innings(docs, match_id)
    b = inn.select("_match", "_doc_format", "_inn", F.posexplode(F.coalesce(F.col("inn.bowler"), F.array()))
                   .alias("pos", "b"))
    return read_fields(
        b.where(non_blank(F.col("b.id"))),
        [F.coalesce(F.col("_doc_format"), F.lit(fmt)).alias("format"), *_line_numbers(),
         text_or("b.name", UNKNOWN).alias("name")],
        {"player_id": _number("b.id", parse_long, None), "match_id": _number("_match", parse_long, None),
         "overs_bowled": _decimal("b.overs", 4, 1), "runs_conceded": _number("b.runs"),
         "wickets_taken": _number("b.wickets"), "economy_rate": _decimal("b.econ", 4, 2)}, with_faults)


#: natural keys: a line's place in its match, a partnership's pair and places
LINE_KEYS = ["match_id", "innings_number", "line_number", "player_id"]
PARTNERSHIP_KEYS = ["match_id", "innings_number", "player1_id", "player2_id", "batting_position1", "batting_position2"]


def stat_id(*cols: str) -> Column:
    """Deterministic surrogate id from a natural key; never compared in its place."""
    return F.xxhash64(*[F.col(c) for c in cols])


def made_columns(table: str) -> dict[str, Column]:
    """The columns of a line table that follow from its others."""
    if table == "player_recent_form":
        return {"is_above_50": F.col("runs_scored") >= 50}
    return {"stat_id": stat_id(*LINE_KEYS)} if table == "fielding_stats" else {"partnership_id": stat_id(*PARTNERSHIP_KEYS)}


# ---------------------------------------------------------------------------
# Player match list
# ---------------------------------------------------------------------------

def extract_player_match(docs: DataFrame, player_id: str = "playerId", with_faults: bool = False) -> DataFrame:
    """Match list rows with a date, runs and a non-zero ball count.

    strike_rate = round((runs / balls) * 100, 2) computed as the source does:
    floating-point division and product, then Python's rounding (`round_float`).
    """
    m = docs.select(F.col(player_id).cast("string").alias("_player"),
                    F.explode(F.coalesce(F.col("matchBattingStatsList"), F.array())).alias("m"))
    runs, balls, day = parse_int("m.runs"), parse_int("m.ballsFaced"), F.col("m.matchDate").try_cast("date")
    there = non_blank(F.col("m.matchDate")) & non_blank(F.col("m.runs")) & non_blank(F.col("m.ballsFaced"))
    rate = round_float(F.try_divide(runs.cast("double"), balls.cast("double")) * F.lit(100.0))
    keep = there & (F.coalesce(balls != 0, F.lit(True)) if with_faults else runs.isNotNull() & (balls != 0))
    return read_fields(
        m.where(keep), [rate.alias("strike_rate")],
        {"player_id": _number("_player", parse_long, None), "match_date": (F.col("m.matchDate"), day, None),
         "runs_scored": (F.col("m.runs"), runs, None), "_balls": (F.col("m.ballsFaced"), balls, None)},
        with_faults).drop("_balls")


# ---------------------------------------------------------------------------
# Detailed scorecards
# ---------------------------------------------------------------------------

def _detailed_innings(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("matchId").cast("string").alias("_match"),
                       F.col("matchHeader.startDate").alias("start_ms"),
                       F.posexplode(F.coalesce(F.col("innings"), F.array())).alias("_inn", "inn"))


def extract_recent_form(docs: DataFrame, with_faults: bool = False) -> DataFrame:
    """Batters of every innings -> player_recent_form rows (`is_above_50` = runs >= 50).

    Documents without a header date or innings yield nothing (source guard).
    """
    inn = _detailed_innings(docs.where(F.col("matchHeader.startDate").isNotNull()))
    b = inn.select("_match", "start_ms", "_inn",
                   F.posexplode(F.coalesce(F.col("inn.batting.batters"), F.array())).alias("pos", "b"))
    rate = round_dec(parse_double("b.strikeRate"), 7)
    rows = read_fields(
        b.where(non_blank(F.col("b.id"))), _line_numbers(),
        {"player_id": _number("b.id", parse_long, None), "match_id": _number("_match", parse_long, None),
         "runs_scored": _number("b.runs"), "balls_faced": _number("b.balls"),
         "strike_rate": (F.col("b.strikeRate"), F.when(F.abs(rate) < 1000, rate), round_dec(F.lit(0.0), 7)),
         "match_date": (F.col("start_ms"), epoch_ms_to_date("start_ms"), None)}, with_faults)
    return rows.withColumns(made_columns("player_recent_form"))


def extract_fielding(docs: DataFrame, with_faults: bool = False) -> DataFrame:
    """I16: fielders of every innings -> fielding_stats rows, counts default 0."""
    inn = _detailed_innings(docs)
    p = inn.select("_match", "_inn", F.posexplode(F.coalesce(F.col("inn.fielding.players"), F.array())).alias("pos", "p"))
    rows = read_fields(
        p.where(non_blank(F.col("p.id"))), _line_numbers(),
        {"player_id": _number("p.id", parse_long, None), "match_id": _number("_match", parse_long, None),
         "catches": _number("p.catches"), "stumpings": _number("p.stumpings"), "runouts": _number("p.runouts")},
        with_faults)
    return rows.withColumns(made_columns("fielding_stats"))


def extract_partnerships(docs: DataFrame, with_faults: bool = False) -> DataFrame:
    """Partnerships -> batting_partnerships rows (two-element batsmen array)."""
    inn = _detailed_innings(docs)
    p = inn.select("_match", F.col("inn.inningsId").alias("_no"),
                   F.explode(F.coalesce(F.col("inn.partnerships"), F.array())).alias("p"))
    p = p.where(F.size("p.batsmen") >= 2).select("*", F.try_element_at("p.batsmen", F.lit(1)).alias("b1"),
                                                 F.try_element_at("p.batsmen", F.lit(2)).alias("b2"))
    rows = read_fields(p, [], {
        "match_id": _number("_match", parse_long, None), "innings_number": _number("_no", parse_int, None),
        "player1_id": _number("b1.id", parse_long, None), "player2_id": _number("b2.id", parse_long, None),
        "batting_position1": _number("b1.position", parse_int, None),
        "batting_position2": _number("b2.position", parse_int, None),
        "partnership_runs": _number("p.runs", parse_int, None)}, with_faults)
    return rows.withColumns(made_columns("batting_partnerships"))


# ---------------------------------------------------------------------------
# Career documents
# ---------------------------------------------------------------------------

def _career_stats(docs: DataFrame) -> DataFrame:
    return docs.select(parse_long("playerId").alias("player_id"), "kind",
                       F.explode(F.coalesce(F.col("stats"), F.array())).alias("s"))


def quarterly_months(batting_docs: DataFrame, with_faults: bool = False) -> DataFrame:
    """The months of every timeline, with their quarter; unreadable numbers as in `read_fields`."""
    s = _career_stats(batting_docs)
    t = s.select("player_id", F.col("s.format").alias("format"),
                 F.explode(F.coalesce(F.col("s.timeline"), F.array())).alias("t"))
    rows = read_fields(t, [F.col("player_id"), F.col("format")], {
        "year": _number("t.year"), "month": _number("t.month", parse_int, 1), "runs": _number("t.runs"),
        "sr": _decimal("t.strikeRate", 9, 2), "matches": _number("t.matches")}, with_faults)
    return rows.withColumn("quarter", month_to_quarter("month"))


MONTH_KEYS = ["player_id", "format", "year", "quarter", "month"]
QUARTER_KEYS = ["player_id", "year", "quarter", "format"]
#: a player's months and quarters of a format share a part of their stored tables
CAREER_PART = ["player_id", "format"]


def month_states(months: DataFrame, *also: str) -> DataFrame:
    """Mergeable state of every month: exact sums from which quarters follow without reading documents again."""
    return months.groupBy(*also, *MONTH_KEYS).agg(
        F.sum("runs").cast("bigint").alias("runs"),
        F.sum(F.col("sr") * F.col("matches")).cast("decimal(38,2)").alias("weighted_sr"),
        F.sum("matches").cast("bigint").alias("matches"))


def quarters_of(states: DataFrame, told: DataFrame | None = None, also: str | None = None) -> DataFrame:
    """I14 from month states: runs and matches summed, the strike rate averaged by matches.

    With `told`, only the quarters in which it has months: the quarters' months
    and the keys told meet in one grouping.
    """
    rows = states.withColumn("_told", F.lit(told is None))
    if told is not None:
        rows = rows.unionByName(told.select(*QUARTER_KEYS, F.lit(True).alias("_told")), allowMissingColumns=True)
    return (rows.groupBy(*([also] if also else []), *QUARTER_KEYS)
            .agg(F.sum("runs").cast("int").alias("total_runs"),
                 round_dec(F.try_divide(F.sum("weighted_sr"), F.sum("matches")), 7).alias("strike_rate"),
                 F.sum("matches").cast("int").alias("matches_played"), F.max("_told").alias("_told"))
            .where("_told").drop("_told"))


def extract_quarterly(batting_docs: DataFrame, reject: bool = False) -> DataFrame:
    """Monthly timeline -> one row per (player, year, quarter, format).

    The source emits one row per *month* under a per-quarter key (SURVEY D4);
    months are rolled up: runs and matches summed, the strike rate averaged
    with the month's match count as weight.  `reject=True` leaves out months
    with unreadable numbers.
    """
    months = quarterly_months(batting_docs, with_faults=True)
    if reject:
        months = months.where(F.col(FAULT) == "")
    return quarters_of(month_states(months))


def merge_format_summary(batting_docs: DataFrame, bowling_docs: DataFrame, reject: bool = False) -> DataFrame:
    """Full merge of batting and bowling career stats by (player, format), defaults 0.

    A format listed twice keeps its last entry (the source builds a dict by
    format): of several documents the last in document order (`_doc_order`, if
    the documents carry it), in a document the last by position; entries that
    agree in both are ordered by their values, so the pick never depends on the
    order of rows.  `reject=True` leaves out entries with unreadable numbers
    (`career_faults` has them).
    """
    def last_per_format(docs: DataFrame, fields: dict[str, Column], read: dict) -> DataFrame:
        order = F.col(DOC_ORDER) if DOC_ORDER in docs.columns else F.lit(0)
        s = docs.select(parse_long("playerId").alias("player_id"), order.alias("_doc"),
                        F.posexplode(F.coalesce(F.col("stats"), F.array())).alias("i", "s"))
        good = F.lit(True)
        for k, size in read.items() if reject else ():
            parsed = parse_int(f"s.{k}") if size is None else parse_decimal(f"s.{k}", *size)
            good = good & ~unreadable(f"s.{k}", parsed)
        s = s.where(F.col("s.format").isNotNull() & good).select(
            "player_id", F.col("s.format").alias("format"), "_doc", "i", *[c.alias(k) for k, c in fields.items()])
        rest = list(fields)
        return (s.groupBy("player_id", "format")
                .agg(F.max(F.struct("_doc", "i", *rest)).alias("_v"))
                .select("player_id", "format", *[F.col(f"_v.{k}").alias(k) for k in rest]))

    bat = last_per_format(batting_docs, {
        "total_runs": parse_int("s.runs"), "batting_average": parse_decimal("s.average", 7, 2),
        "strike_rate": parse_decimal("s.strikeRate", 7, 2), "centuries": parse_int("s.hundreds"),
        "matches_played": parse_int("s.matches"), "innings_played": parse_int("s.innings")}, BATTING_FIELDS)
    bowl = last_per_format(bowling_docs, {
        "total_wickets": parse_int("s.wickets"), "bowling_average": parse_decimal("s.average", 7, 2),
        "economy_rate": parse_decimal("s.economyRate", 7, 2)}, BOWLING_FIELDS)
    j = bat.join(bowl, ["player_id", "format"], "full_outer")
    z_int, z_dec = F.lit(0), F.lit(0).cast("decimal(7,2)")
    return j.select(
        "player_id", "format",
        F.coalesce("total_runs", z_int).alias("total_runs"),
        F.coalesce("total_wickets", z_int).alias("total_wickets"),
        F.coalesce("batting_average", z_dec).alias("batting_average"),
        F.coalesce("bowling_average", z_dec).alias("bowling_average"),
        F.coalesce("strike_rate", z_dec).alias("strike_rate"),
        F.coalesce("economy_rate", z_dec).alias("economy_rate"),
        F.coalesce("centuries", z_int).alias("centuries"),
        F.coalesce("matches_played", z_int).alias("matches_played"),
        F.coalesce("innings_played", z_int).alias("innings_played"))


# ---------------------------------------------------------------------------
# Master ingest
# ---------------------------------------------------------------------------

def career_faults(docs: DataFrame, fields: dict[str, tuple[int, int] | None]) -> DataFrame:
    """Career entries with unreadable numbers: player_id, format, fault.

    `fields` names the entry's fields: None for an integer, else a decimal's (precision, scale).
    """
    s = _career_stats(docs)
    numbers = {k: _number(f"s.{k}") if size is None else _decimal(f"s.{k}", *size) for k, size in fields.items()}
    rows = read_fields(s, [F.col("player_id"), F.col("s.format").alias("format")], numbers, with_faults=True)
    return rows.where(F.col(FAULT) != "").select("player_id", "format", FAULT)


BATTING_FIELDS = {"runs": None, "average": (7, 2), "strikeRate": (7, 2), "hundreds": None, "matches": None,
                  "innings": None}
BOWLING_FIELDS = {"wickets": None, "average": (7, 2), "economyRate": (7, 2)}


MONTHS_TABLE = "player_monthly_states"


def ingest_all(scorecards: DataFrame, batting_docs: DataFrame, bowling_docs: DataFrame, out_dir: str,
               existing: dict[str, DataFrame] | None = None, parts: int = DEFAULT_PARTS,
               staged: bool = False) -> list[LoadReport]:
    """*all* documents -> five tables, safe to run again.

    Lines (recent form, fielding, partnerships) are appended once: rows whose
    natural key is stored already are skipped (I8); the stored tables are read
    from `out_dir` unless `existing` gives them.

    Summaries and quarters are upserted (last wins, SURVEY D5): a player's
    (player, format) row is replaced by the latest ingest's.  Months are kept
    as mergeable states in `player_monthly_states`; an ingest replaces the
    months that its documents tell and rolls up the quarters of these months
    from all their stored months, so a quarter that was stored before its last
    month is completed by a later ingest.  Only the partitions in which a row
    changes are rewritten (`upsert_rows`).

    Each document set is staged in parsed form once, and every pass reads these
    files; `staged=True` tells that the documents given are read from such files.
    """
    spark, existing = scorecards.sparkSession, existing or {}
    scratch = []
    if not staged:
        (scorecards, batting_docs, bowling_docs), scratch, _ = zip(
            *(stage_lines(df, name) for df, name in ((scorecards, "scorecards"), (batting_docs, "batting-careers"),
                                                     (bowling_docs, "bowling-careers"))), strict=True)
    reports = []
    for table, (df, keys) in {
            "player_recent_form": (extract_recent_form(scorecards, with_faults=True), LINE_KEYS),
            "fielding_stats": (extract_fielding(scorecards, with_faults=True), LINE_KEYS),
            "batting_partnerships": (extract_partnerships(scorecards, with_faults=True), PARTNERSHIP_KEYS)}.items():
        bad = df.where(F.col(FAULT) != "").count()
        made = made_columns(table)  # columns that follow from a line's others do not travel
        lines = df.where(F.col(FAULT) == "").drop(FAULT, *made)
        stored = existing.get(table)
        if stored is None and path_exists(spark, os.path.join(out_dir, table)):
            stored = load_table(spark, out_dir, table)
        if stored is None:
            fresh = dedupe_all(lines, keys)
        else:
            there = met_rows(stored.select(*keys), lines, keys, null_safe=True) if is_small(scorecards) else stored
            fresh = fresh_rows(lines, there, keys)
        reports.append(append_rows(fresh.withColumns(made), out_dir, table, rejected=bad))
        if bad:
            keep_rejects(faulty_lines(df, FAULT), out_dir, table)

    # faulty career entries and months never reach the aggregates; they are counted on their own
    faults = career_faults(batting_docs, BATTING_FIELDS).unionByName(career_faults(bowling_docs, BOWLING_FIELDS))
    if bad := faults.count():
        keep_rejects(faulty_lines(faults, FAULT), out_dir, "player_format_summary")
    reports.append(upsert_rows(merge_format_summary(batting_docs, bowling_docs, reject=True), out_dir,
                               "player_format_summary", ["player_id", "format"], parts=parts, rejected=bad))
    months, months_path, bad = stage_lines(quarterly_months(batting_docs, with_faults=True), "months", FAULT)
    if bad:
        keep_rejects(faulty_lines(months, FAULT), out_dir, "player_quarterly_stats")
    reports.append(upsert_months(months.where(F.col(FAULT) == "").drop(FAULT), out_dir, parts, rejected=bad))
    for path in (*scratch, months_path):
        delete_folder(spark, path)
    return reports


def upsert_months(months: DataFrame, out_dir: str, parts: int = DEFAULT_PARTS, rejected: int = 0) -> LoadReport:
    """Store the months' states, then the quarters that they belong to; the report is of the quarters."""
    spark, stored = months.sparkSession, os.path.join(out_dir, MONTHS_TABLE)
    first, path = not path_exists(spark, stored), None
    # the rows of a part meet once: their sums need no further exchange, and a first load writes them there
    told = month_states(in_parts(months, CAREER_PART, parts), "_part").drop("_part")
    if not first:
        told, path, _ = stage_lines(told, MONTHS_TABLE)
    upsert_rows(told, out_dir, MONTHS_TABLE, MONTH_KEYS, part_keys=CAREER_PART, parts=parts, staged=True, arranged=first)
    states = spark.read.schema(told.schema).parquet(stored).select(*told.columns)
    if first:  # all stored months are told
        quarters = quarters_of(in_parts(states, CAREER_PART, parts), also="_part").drop("_part")
    elif is_small(told):
        quarters = quarters_of(met_rows(states, told, QUARTER_KEYS, null_safe=True))
    else:
        quarters = quarters_of(states, told)
    report = upsert_rows(quarters, out_dir, "player_quarterly_stats", QUARTER_KEYS, part_keys=CAREER_PART, parts=parts,
                         rejected=rejected, arranged=first)
    if path:
        delete_folder(spark, path)
    return report


def stub_players(facts: DataFrame, players: DataFrame) -> DataFrame:
    """I10 for players seen in scorecards: id + name, other columns 'Unknown'."""
    return ensure_members(facts.select("player_id", F.col("name").alias("full_name")), players, "player_id",
                          name_col="full_name",
                          defaults={"country": UNKNOWN, "playing_role": UNKNOWN,
                                    "batting_style": UNKNOWN, "bowling_style": UNKNOWN})

