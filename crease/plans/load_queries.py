"""Registered queries over stored rows: loads run twice, rejects, numbering, checks of all tables.

Inputs are derived from the test tables by Spark; every query runs the
operator over whole tables and has plain SQL for the rows it must give.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from crease import load
from crease.operators import ingest as I
from crease.operators import loads as L
from crease.operators import products as P
from crease.operators import states as S
from crease.operators.changes import apply_changes
from crease.operators.keys import consecutive_ids
from crease.operators.upsert import read_upserted, upsert_rows
from crease.operators.quality import check_castable, check_types, check_unique
from crease.plans import nesting as N
from crease.plans.analytics import q20a_format_counts, trend_of_quarters
from crease.plans.oracle_sql import ORACLE_QUERIES, r2, with_tables
from crease.plans.registry import normalize_types
from crease.session import shared_folder
from crease.sources.documents import parse_documents, read_documents
from crease.sources.fixtures import fixture_tables, read_base
from crease.sources.schemas import PRIMARY_KEYS, TABLE_DDL, VARCHAR_WIDTHS, doc_schema
from crease.sources.sinks import append_rows, rejects_path, stage_lines
from crease.sources.tables import create_tables, load_table
from crease.streaming.incremental import keyed_load, run_incremental_load


def _docs(df: DataFrame, schema_name: str) -> DataFrame:
    return parse_documents(df, "value", doc_schema(schema_name))[0]


def _twice(docs: DataFrame, column: str) -> DataFrame:
    """Documents whose list of innings is doubled: the same players and lines in two innings."""
    return docs.withColumn(column, F.concat(column, column))


def _landed(docs: DataFrame, name: str) -> DataFrame:
    """Documents built and parsed once, in files that several loads read."""
    return stage_lines(docs, name)[0]


def _stored_after_two_loads(spark: SparkSession, load: Callable[[str], object], table: str) -> DataFrame:
    out = shared_folder(spark, "load")
    load(out)
    load(out)
    return load_table(spark, out, table)


def q_load_batting(spark: SparkSession, d: str) -> DataFrame:
    docs = _twice(_landed(_docs(N.scorecard_docs(spark, d), "scorecard"), "cards"), "scorecard")
    return _stored_after_two_loads(spark, lambda out: L.load_batting(docs, out), "batting_stats").drop("stat_id")


def q_load_bowling(spark: SparkSession, d: str) -> DataFrame:
    docs = _twice(_landed(_docs(N.scorecard_docs(spark, d), "scorecard"), "cards"), "scorecard")
    return _stored_after_two_loads(spark, lambda out: L.load_bowling(docs, out), "bowling_stats").drop("stat_id")


def q_load_player_match(spark: SparkSession, d: str) -> DataFrame:
    docs = _twice(_landed(_docs(N.player_match_docs(spark, d), "player_matches"), "match-lists"), "matchBattingStatsList")
    return _stored_after_two_loads(spark, lambda out: L.load_player_match(docs, out), "player_match")


_masters: dict[tuple[str, str], str] = {}


def _master(spark: SparkSession, d: str, table: str) -> DataFrame:
    """One table of a master ingest that ran twice; the queries of an application share the ingest."""
    run = (spark.sparkContext.applicationId, d)
    if run not in _masters:
        _masters[run] = _master_ingest(spark, d)
    return load_table(spark, _masters[run], table)


def _master_ingest(spark: SparkSession, d: str) -> str:
    t = fixture_tables(spark, d)
    scorecards = _landed(_docs(N.detailed_docs(t), "detailed_scorecard"), "cards")
    first = F.col("innings")[0]  # both innings get the first one's batters and fielders
    scorecards = scorecards.withColumn("innings", F.transform("innings", lambda x: x.withField(
        "batting", first["batting"]).withField("fielding", first["fielding"])))
    bat, bowl = (_landed(_docs(x, "career"), "careers") for x in N.career_docs(spark, d))
    out = shared_folder(spark, "master")
    for _ in range(2):
        I.ingest_all(scorecards, bat, bowl, out, staged=True)
    return out


def q_master_recent_form(spark: SparkSession, d: str) -> DataFrame:
    return _master(spark, d, "player_recent_form")


def q_master_fielding(spark: SparkSession, d: str) -> DataFrame:
    return _master(spark, d, "fielding_stats").drop("stat_id")


def q_master_summary(spark: SparkSession, d: str) -> DataFrame:
    return _master(spark, d, "player_format_summary")


def _later_careers(docs: DataFrame, months: bool) -> DataFrame:
    """The next state of career documents: even players only, numbers raised, months before July dropped."""
    def later(s):
        raised = {k: (s[k].cast("int") + 1000).cast("string") for k in (("runs",) if months else ("wickets",))}
        for k, v in raised.items():
            s = s.withField(k, v)
        if not months:
            return s
        kept = F.filter(s["timeline"], lambda t: t["month"].cast("int") >= 7)
        return s.withField("timeline", F.transform(kept, lambda t: t.withField(
            "runs", (t["runs"].cast("int") + 5).cast("string"))))

    return docs.where(F.col("playerId").cast("long") % 2 == 0).withColumn("stats", F.transform("stats", later))


_refreshed: dict[tuple[str, str], str] = {}


def _refresh(spark: SparkSession, d: str, table: str) -> DataFrame:
    """One table after an ingest of all careers and one of some players' next state."""
    run = (spark.sparkContext.applicationId, d)
    if run not in _refreshed:
        t = fixture_tables(spark, d)
        bat, bowl = (_landed(_docs(x, "career"), "careers") for x in N.career_docs(spark, d))
        none = _docs(N.detailed_docs(t), "detailed_scorecard").where("false")
        out = shared_folder(spark, "refreshed")
        I.ingest_all(none, bat, bowl, out, staged=True)
        I.ingest_all(none, _later_careers(bat, True), _later_careers(bowl, False), out, staged=True)
        _refreshed[run] = out
    return load_table(spark, _refreshed[run], table)


def q_refreshed_summary(spark: SparkSession, d: str) -> DataFrame:
    return _refresh(spark, d, "player_format_summary")


def q_refreshed_quarters(spark: SparkSession, d: str) -> DataFrame:
    return _refresh(spark, d, "player_quarterly_stats")


def _faulty_bowling(spark: SparkSession, d: str) -> DataFrame:
    """Bowling documents with thousands separators, bad text and rates that do not fit, by run count."""
    docs = _docs(N.scorecard_docs(spark, d), "scorecard")

    def spoil(b):
        kind = b["runs"].cast("int") % 7
        return b.withField("runs", F.when(kind == 0, "1,234").when(kind == 1, "abc").otherwise(b["runs"])) \
            .withField("econ", F.when(kind == 2, "120.0").otherwise(b["econ"]))

    return docs.withColumn("scorecard", F.transform("scorecard", lambda x: x.withField(
        "bowler", F.transform(x["bowler"], spoil))))


def q_rejected_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines by their fault ('' for good ones), with the runs of the good ones."""
    lines = I.extract_bowling(_faulty_bowling(spark, d), with_faults=True)
    return lines.select("player_id", "match_id", "format", "line_number", I.FAULT,
                        F.when(F.col(I.FAULT) == "", F.col("runs_conceded")).alias("runs_conceded"))


def q_load_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports of a load with rejects, run twice."""
    docs, out = _landed(_faulty_bowling(spark, d), "cards"), shared_folder(spark, "load")
    rows = [(run, r.table, r.inserted, r.rejected) for run in (1, 2) for r in L.load_bowling(docs, out)]
    return spark.createDataFrame(rows, "run int, table_name string, inserted long, rejected long")


def q_read_documents(spark: SparkSession, d: str) -> DataFrame:
    """Landed files of documents and of lines that are none; with the count that the parse itself observed."""
    path = shared_folder(spark, "landing")
    e = read_base(spark, d, "events")
    bad = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{not json "), F.col("event_id")))
    e.select(F.coalesce(bad, F.to_json(F.struct(F.col("event_id").cast("string").alias("matchId"))))
             .alias("value")).write.text(path)
    seen = Observation()
    good, _ = read_documents(spark, path, doc_schema("scorecard"), observe=seen)
    rows, _, _ = stage_lines(good.select("matchId"), "docs")
    _, rejected = read_documents(spark, path, doc_schema("scorecard"))
    counted = int(seen.get["rejected"])
    return rows.select(F.col("matchId").cast("long").alias("event_id"), F.lit("good").alias("kind"),
                       F.lit(counted).cast("long").alias("rejected")) \
        .unionByName(rejected.select(F.regexp_extract("raw", r"(\d+)$", 1).cast("long").alias("event_id"),
                                     F.lit("bad").alias("kind"), F.lit(counted).cast("long").alias("rejected")))


def q_create_and_append(spark: SparkSession, d: str) -> DataFrame:
    """All tables created empty, the teams appended once whole and once empty; rows per table."""
    t, out = fixture_tables(spark, d), shared_folder(spark, "tables")
    create_tables(spark, out)
    append_rows(t["teams"], out, "teams")
    append_rows(t["teams"].where("false"), out, "teams")
    create_tables(spark, out)
    return reduce(DataFrame.unionByName, [
        load_table(spark, out, n).agg(F.count("*").alias("stored_rows")).select(F.lit(n).alias("table_name"),
                                                                                "stored_rows") for n in TABLE_DDL])


def q_first_present(spark: SparkSession, d: str) -> DataFrame:
    e = read_base(spark, d, "events").select(
        "event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("a"),
        F.when(F.col("event_id") % 3 == 0, F.lit("third")).alias("b"))
    return e.select("event_id", I.first_present("a", "b").alias("found"))


def q_missing_members(spark: SparkSession, d: str) -> DataFrame:
    """Stubs for the players that a dimension of odd ids lacks."""
    bat = I.extract_batting(_docs(N.scorecard_docs(spark, d), "scorecard"))
    return I.stub_players(bat, fixture_tables(spark, d)["players"].where("player_id % 2 = 1"))


def q_consecutive_ids(spark: SparkSession, d: str) -> DataFrame:
    """Numbers 1.. for every lineitem row in key order, with payload columns."""
    li = read_base(spark, d, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    rows = li.select(*keys, F.repeat(F.col("l_returnflag"), F.lit(20)).alias("payload"))
    return consecutive_ids(rows, keys, id_col="id").select("id", "l_orderkey", "l_partkey", "l_suppkey")


def q_check_all_keys(spark: SparkSession, d: str) -> DataFrame:
    """Violations of every declared key (number of repeated or null keys, and their rows)."""
    t = fixture_tables(spark, d)
    return reduce(DataFrame.unionByName, [
        check_unique(t[n], k).agg(F.count("*").alias("bad_keys"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"))
        .select(F.lit(n).alias("table_name"), "bad_keys", "row_count") for n, k in PRIMARY_KEYS.items()])


def q_check_all_widths(spark: SparkSession, d: str) -> DataFrame:
    t = fixture_tables(spark, d)
    return reduce(DataFrame.unionByName, [
        check_types(t[n], n, w).select(F.lit(n).alias("table_name"), "column_name", "max_width", "violations", "longest")
        for n, w in VARCHAR_WIDTHS.items()])


def q_check_castable(spark: SparkSession, d: str) -> DataFrame:
    """Texts that are no INT: every third customer's code is its name."""
    c = read_base(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name"))
                                               .otherwise(F.col("c_custkey").cast("string")).alias("code"))
    return check_castable(c, "code", "int")


def _change_set(players: DataFrame) -> DataFrame:
    """Sequences of changes per key: U-I, D-I, D-U and I-U-D among them; blank inserts and bad ids."""
    pid = F.col("player_id")

    def part(rows: DataFrame, op: str, seq: int, key, name: str | None, country: str | None) -> DataFrame:
        return rows.select(F.lit(op).alias("op"), F.lit(seq).cast("bigint").alias("seq"), key.alias("player_id"),
                           F.lit(name).cast("string").alias("full_name"), F.lit(country).cast("string").alias("country"))

    return reduce(DataFrame.unionByName, [
        part(players, "U", 1, pid, None, "early"),
        part(players.where(pid % 5 == 0), "D", 2, pid, None, None),
        part(players.where(pid % 10 == 0), "U", 3, pid, "late", None),
        part(players.where(pid % 7 == 0), "I", 4, pid, "twice", "x"),
        part(players.where(pid % 4 == 1), "I", 5, pid + 10_000_000, "  new ", "c"),
        part(players.where(pid % 4 == 2), "I", 6, pid + 10_000_000, "  ", "c"),
        part(players.where(pid % 4 == 3), "I", 7, -pid, "n", "c"),
        part(players.where(pid % 8 == 1), "U", 8, pid + 10_000_000, None, "changed"),
        part(players.where(pid % 16 == 1), "D", 9, pid + 10_000_000, None, None),
        part(players.where(pid % 32 == 1), "I", 10, pid + 10_000_000, "again", "d"),
        part(players.where(pid % 64 == 1), "I", 11, pid + 10_000_000, "no more", "e")])


def q_apply_many_changes(spark: SparkSession, d: str) -> DataFrame:
    players = fixture_tables(spark, d)["players"]
    return apply_changes(players, _change_set(players), ["player_id"])[0].select("player_id", "full_name", "country",
                                                                                 "playing_role")


def q_rejected_changes(spark: SparkSession, d: str) -> DataFrame:
    players = fixture_tables(spark, d)["players"]
    return apply_changes(players, _change_set(players), ["player_id"])[1]


def q_squad_lists(spark: SparkSession, d: str) -> DataFrame:
    """Both squad shapes, names in document order as one text."""
    docs = _docs(N.squad_docs(spark, d), "squad")
    names = F.transform(F.filter(F.col("team")[0]["players"], lambda p: p["playingRole"] == "Bench"), lambda p: p["name"])
    kind = docs.schema["players"].dataType
    fields = [names.alias(f.name) if f.name == "bench" else F.lit(None).cast(f.dataType).alias(f.name) for f in kind]
    both = docs.withColumn("players", F.struct(*fields).cast(kind))
    return P.squad_lists(both).select("matchId", "group", F.array_join("names", ";").alias("names"))


def q_ranking_list(spark: SparkSession, d: str) -> DataFrame:
    return P.ranking_list(_docs(N.ranking_docs(spark, d), "rankings"), "odi")


def _event_versions(spark: SparkSession, d: str) -> tuple[str, int]:
    """A folder with versions of every event, each version in files of its own; and the number of files."""
    e = read_base(spark, d, "events")
    source = shared_folder(spark, "events")
    for version, some in ((3, "true"), (1, "event_id % 3 <> 0"), (2, "true")):  # the first file has no first version
        e.where(some).select("event_id", F.lit(version).alias("version"), (F.col("value") + version).alias("value")) \
            .write.parquet(f"{source}/v{version}")
    return source, len(spark.read.parquet(f"{source}/*").inputFiles())


def _in_batches(spark: SparkSession, d: str, load: Callable) -> DataFrame:
    """The stored rows of a load in many small batches, and of one in a single batch."""
    source, files = _event_versions(spark, d)
    schema = spark.read.parquet(f"{source}/v1").schema
    outs = []
    for batches, some in (("many", max(1, files // 6)), ("one", files)):
        target = shared_folder(spark, "events-target")
        load(spark, f"{source}/*", schema, target, some)
        outs.append(spark.read.schema(schema).parquet(target).select(*schema.fieldNames(), F.lit(batches).alias("batches")))
    return outs[0].unionByName(outs[1])


def q_events_in_batches(spark: SparkSession, d: str) -> DataFrame:
    """Versions of every event, loaded in many batches and in one."""
    return _in_batches(spark, d, lambda s, source, schema, target, files: run_incremental_load(
        s, source, schema, target, ["event_id"], ["version"], checkpoint=f"{target}-checkpoint",
        max_files_per_trigger=files))


def q_events_by_keyed_state(spark: SparkSession, d: str) -> DataFrame:
    """The same by the continuous load, whose state store holds each event's kept row."""
    def load(s, source, schema, target, files):
        q = keyed_load(s, source, schema, target, ["event_id"], ["version"], f"{target}-checkpoint",
                       max_files_per_trigger=files, every=None, parts=16)
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()

    return _in_batches(spark, d, load)


def q_kept_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Rejects that the load of landed files keeps: documents that are none, lines with unreadable numbers."""
    landing, tables = shared_folder(spark, "landing"), shared_folder(spark, "tables")
    docs = _faulty_bowling(spark, d)
    docs.select(F.to_json(F.struct(*docs.columns)).alias("value")).write.text(f"{landing}/cards")
    read_base(spark, d, "events").where("event_id % 10 = 0") \
        .select(F.concat(F.lit("{not json "), F.col("event_id")).alias("value")).write.text(f"{landing}/events")
    load.run(spark, "bowling", f"{landing}/*", tables)
    bad, lines = (spark.read.parquet(rejects_path(tables, n)) for n in ("documents-bowling", "bowling_stats"))
    line = F.from_json("raw", "match_id bigint, player_id bigint, format string, line_number bigint")
    return bad.select(F.lit("document").alias("kind"), "reason", F.regexp_extract("raw", r"(\d+)$", 1).cast("long").alias("id"),
                      F.lit(None).cast("long").alias("player_id"), F.lit(None).cast("string").alias("format"),
                      F.lit(None).cast("long").alias("line_number")) \
        .unionByName(lines.select(F.lit("line").alias("kind"), "reason", line.alias("x")).select(
            "kind", "reason", F.col("x.match_id").alias("id"), "x.player_id", "x.format", "x.line_number"))


def _stored_states(spark: SparkSession, table: str, lines: DataFrame, keys: list[str], state_of) -> DataFrame:
    """States stored for a first part of the lines, then refreshed for the periods of the rest."""
    base = shared_folder(spark, "states")
    later = F.col("player_id") % 3 == 0
    upsert_rows(state_of(lines.where(~later | (F.dayofmonth("match_date") < 15))), base, table, keys, part_keys=["player_id"])
    touched = lines.where(later).select("player_id", S.month_of("match_date").alias("month")).distinct()
    S.refresh_states(lines.withColumn("month", S.month_of("match_date")), touched, state_of, base, table, keys)
    return read_upserted(spark, base, table)


def q_consistent_from_states(spark: SparkSession, d: str) -> DataFrame:
    lines = fixture_tables(spark, d)["player_recent_form"]
    states = _stored_states(spark, "form_states", lines, ["player_id", "month"], S.form_states)
    return S.consistent_batsmen_from_states(states, lines, "1996-01-01")


def q_consistent_from_a_broken_month(spark: SparkSession, d: str) -> DataFrame:
    lines = fixture_tables(spark, d)["player_recent_form"]
    states = _stored_states(spark, "form_states", lines, ["player_id", "month"], S.form_states)
    return S.consistent_batsmen_from_states(states, lines, "1996-01-17")


def q_trend_from_states(spark: SparkSession, d: str) -> DataFrame:
    lines = fixture_tables(spark, d)["player_match"]
    states = _stored_states(spark, "match_states", lines, ["player_id", "month"], S.match_states)
    return trend_of_quarters(S.quarters_from_states(states))


def q_matches_by_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Distinct matches per player: exact, and whether both estimates (one pass, united states) are within 5 %."""
    t = fixture_tables(spark, d)
    exact = q20a_format_counts(t).select("player_id", "matches_played")
    one = q20a_format_counts(t, approximate=True).select("player_id", F.col("matches_played").alias("once"))
    bat = t["batting_stats"].join(t["matches"].select("match_id", F.year("match_date").alias("year")), "match_id", "left")
    states = S.distinct_states(bat, ["player_id", "format", "year"], "match_id")
    united = S.merge_distinct(states, ["player_id"]).select("player_id", F.col("distinct").alias("united"))
    off = F.greatest(F.abs(F.col("once") - F.col("matches_played")), F.abs(F.col("united") - F.col("matches_played")))
    return exact.join(one, "player_id").join(united, "player_id").select(
        "player_id", "matches_played", (off <= 0.05 * F.col("matches_played")).alias("near"))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q19b_consistent_from_states": q_consistent_from_states,
    "q19c_consistent_from_a_broken_month": q_consistent_from_a_broken_month,
    "q25b_trend_from_states": q_trend_from_states,
    "q20c_matches_by_sketch": q_matches_by_sketch,
    "i11b_load_batting_twice": q_load_batting,
    "i12b_load_bowling_twice": q_load_bowling,
    "i13b_load_player_match_twice": q_load_player_match,
    "i15b_master_recent_form_twice": q_master_recent_form,
    "i16b_master_fielding_twice": q_master_fielding,
    "i18b_master_summary_twice": q_master_summary,
    "i18c_refreshed_summary": q_refreshed_summary,
    "i14b_refreshed_quarters": q_refreshed_quarters,
    "i12c_rejected_lines": q_rejected_lines,
    "r10_load_reports": q_load_reports,
    "r03_read_documents": q_read_documents,
    "r09_create_and_append": q_create_and_append,
    "i01b_first_present": q_first_present,
    "i10b_missing_members": q_missing_members,
    "i09c_consecutive_ids": q_consecutive_ids,
    "c1b_check_all_keys": q_check_all_keys,
    "c3b_check_all_widths": q_check_all_widths,
    "c3c_check_castable": q_check_castable,
    "c5_apply_many_changes": q_apply_many_changes,
    "c4b_rejected_changes": q_rejected_changes,
    "b2b_squad_lists": q_squad_lists,
    "b3b_ranking_list": q_ranking_list,
    "st1b_events_in_batches": q_events_in_batches,
    "st1c_events_by_keyed_state": q_events_by_keyed_state,
    "r04_kept_rejects": q_kept_rejects,
}


_ORDER = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate"
_LO = """(SELECT l.*, o.o_custkey, CAST(l.l_quantity AS INTEGER) AS q,
   CASE l.l_returnflag WHEN 'A' THEN 'Test' WHEN 'N' THEN 'ODI' WHEN 'R' THEN 'T20I' END AS fmt
   FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""
_LINE = f"CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey, fmt ORDER BY {_ORDER}) AS BIGINT)"
_INNINGS = "(SELECT CAST(unnest([1, 2]) AS BIGINT) AS innings_number)"
_ECON = "CAST(l_partkey % 1500 AS DECIMAL(9,2)) * CAST(0.01 AS DECIMAL(3,2))"
_BOWL = f"""SELECT o_custkey AS player_id, l_orderkey AS match_id, fmt AS format, CAST(q % 11 AS DOUBLE) AS overs_bowled,
  l_partkey % 90 AS runs, CAST(l_suppkey % 10 AS BIGINT) AS wickets_taken,
  CASE WHEN q % 11 <> 0 THEN CAST({_ECON} AS DOUBLE) ELSE 0.0 END AS economy_rate, {_LINE} AS line_number FROM {_LO}"""
_FAULTS = f"""SELECT *, CASE runs % 7 WHEN 1 THEN 'runs_conceded' WHEN 2 THEN 'economy_rate' ELSE '' END AS fault
  FROM ({_BOWL})"""


def _keys_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, CAST(COUNT(*) AS BIGINT) AS bad_keys, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS row_count "
        f"FROM (SELECT COUNT(*) AS n FROM {t} GROUP BY {', '.join(k)} HAVING COUNT(*) > 1 OR "
        f"{' OR '.join(f'{c} IS NULL' for c in k)})" for t, k in PRIMARY_KEYS.items())


def _widths_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST({w} AS BIGINT) AS max_width, "
        f"CAST(COUNT(*) FILTER (WHERE LENGTH({c}) > {w}) AS BIGINT) AS violations, "
        f"CAST(MAX(LENGTH({c})) AS BIGINT) AS longest FROM {t}"
        for t, widths in VARCHAR_WIDTHS.items() for c, w in widths.items())


_FIRST_VERSIONS = """
SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version,
       value + CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS value, batches
FROM events, (SELECT unnest(['many', 'one']) AS batches) b"""
_NEW = "player_id > 10000000 AND (player_id - 10000000)"
_STATEMENTS = f"""t1 AS (SELECT player_id, full_name, 'early' AS country, playing_role FROM players),
t2 AS (SELECT * FROM t1 WHERE player_id % 5 <> 0),
t3 AS (SELECT * REPLACE (CASE WHEN player_id % 10 = 0 THEN 'late' ELSE full_name END AS full_name) FROM t2),
t4 AS (FROM t3 UNION ALL SELECT player_id, 'twice', 'x', NULL FROM players
       WHERE player_id % 7 = 0 AND player_id > 0 AND player_id NOT IN (SELECT player_id FROM t3)),
t5 AS (FROM t4 UNION ALL SELECT player_id + 10000000, 'new', 'c', NULL FROM players WHERE player_id % 4 = 1),
t8 AS (SELECT * REPLACE (CASE WHEN {_NEW} % 8 = 1 THEN 'changed' ELSE country END AS country) FROM t5),
t9 AS (SELECT * FROM t8 WHERE NOT ({_NEW} % 16 = 1)),
t10 AS (FROM t9 UNION ALL SELECT player_id + 10000000, 'again', 'd', NULL FROM players WHERE player_id % 32 = 1),
t11 AS (FROM t10 UNION ALL SELECT player_id + 10000000, 'no more', 'e', NULL FROM players
        WHERE player_id % 64 = 1 AND player_id + 10000000 NOT IN (SELECT player_id FROM t10))"""

_ORACLES: dict[str, str] = {
    "i11b_load_batting_twice": f"""
SELECT player_id, match_id, format, runs_scored, balls_faced, strike_rate, batting_position, is_out, innings_number
FROM (SELECT o_custkey AS player_id, l_orderkey AS match_id, fmt AS format, CAST(q * 3 AS BIGINT) AS runs_scored,
        CAST(l_partkey % 120 AS BIGINT) AS balls_faced,
        CAST(CAST(l_partkey % 20000 AS DECIMAL(9,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DOUBLE) AS strike_rate,
        {_LINE} AS batting_position, l_linestatus = 'F' AS is_out FROM {_LO}), {_INNINGS} i""",
    "i12b_load_bowling_twice": f"""
SELECT player_id, match_id, format, overs_bowled, CAST(runs AS BIGINT) AS runs_conceded, wickets_taken, economy_rate,
       line_number, innings_number FROM ({_BOWL}), {_INNINGS} i""",
    "i13b_load_player_match_twice": f"""
SELECT player_id, match_date, runs_scored, strike_rate FROM (
  SELECT o_custkey AS player_id, CAST(l_shipdate AS DATE) AS match_date, CAST(q * 3 AS BIGINT) AS runs_scored,
         CAST(printf('%.2f', (CAST(q * 3 AS DOUBLE) / CAST(l_partkey % 120 AS DOUBLE)) * 100) AS DOUBLE) AS strike_rate
  FROM {_LO} WHERE l_partkey % 120 <> 0), {_INNINGS} i
WHERE strike_rate < 1000""",
    "i15b_master_recent_form_twice": f"""
SELECT player_id, match_id, CAST(runs_scored AS BIGINT) AS runs_scored, CAST(balls_faced AS BIGINT) AS balls_faced,
       CAST(strike_rate AS DOUBLE) AS strike_rate, is_above_50, match_date, innings_number,
       CAST(1 AS BIGINT) AS line_number
FROM player_recent_form, {_INNINGS} i""",
    "i16b_master_fielding_twice": f"""
SELECT player_id, match_id, CAST(COALESCE(catches, 0) AS BIGINT) AS catches, CAST(stumpings AS BIGINT) AS stumpings,
       CAST(runouts AS BIGINT) AS runouts, innings_number, CAST(1 AS BIGINT) AS line_number
FROM fielding_stats, {_INNINGS} i""",
    "i18b_master_summary_twice": """
SELECT player_id, format, CAST(total_runs AS BIGINT) AS total_runs, CAST(total_wickets AS BIGINT) AS total_wickets,
       CAST(COALESCE(batting_average, 0) AS DOUBLE) AS batting_average,
       CAST(COALESCE(bowling_average, 0) AS DOUBLE) AS bowling_average,
       CAST(COALESCE(strike_rate, 0) AS DOUBLE) AS strike_rate,
       CAST(COALESCE(economy_rate, 0) AS DOUBLE) AS economy_rate,
       CAST(centuries AS BIGINT) AS centuries, CAST(matches_played AS BIGINT) AS matches_played,
       CAST(innings_played AS BIGINT) AS innings_played
FROM player_format_summary""",
    "i18c_refreshed_summary": """
SELECT player_id, format, CAST(total_runs + CASE player_id % 2 WHEN 0 THEN 1000 ELSE 0 END AS BIGINT) AS total_runs,
       CAST(total_wickets + CASE player_id % 2 WHEN 0 THEN 1000 ELSE 0 END AS BIGINT) AS total_wickets,
       CAST(COALESCE(batting_average, 0) AS DOUBLE) AS batting_average,
       CAST(COALESCE(bowling_average, 0) AS DOUBLE) AS bowling_average,
       CAST(COALESCE(strike_rate, 0) AS DOUBLE) AS strike_rate,
       CAST(COALESCE(economy_rate, 0) AS DOUBLE) AS economy_rate,
       CAST(centuries AS BIGINT) AS centuries, CAST(matches_played AS BIGINT) AS matches_played,
       CAST(innings_played AS BIGINT) AS innings_played
FROM player_format_summary""",
    "i14b_refreshed_quarters": f"""
WITH monthly AS (
  SELECT o_custkey AS player_id, fmt AS format, YEAR(o_orderdate) AS year, MONTH(o_orderdate) AS month,
         SUM(q * 3) + CASE WHEN o_custkey % 2 = 0 AND MONTH(o_orderdate) >= 7 THEN 5 ELSE 0 END AS runs,
         ROUND(CAST(AVG(CAST(CAST(l_partkey % 20000 AS DECIMAL(9,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(5,2)))
                    AS DECIMAL(18,6)), 2) AS sr,
         COUNT(DISTINCT l_orderkey) AS matches
  FROM (SELECT l.*, o.o_custkey, o.o_orderdate, CAST(l.l_quantity AS INTEGER) AS q,
          CASE l.l_returnflag WHEN 'A' THEN 'Test' WHEN 'N' THEN 'ODI' WHEN 'R' THEN 'T20I' END AS fmt
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
  GROUP BY o_custkey, fmt, YEAR(o_orderdate), MONTH(o_orderdate))
SELECT player_id, CAST(year AS BIGINT) AS year, CAST((month - 1) // 3 + 1 AS BIGINT) AS quarter, format,
       CAST(SUM(runs) AS BIGINT) AS total_runs, {r2('SUM(sr * matches) / NULLIF(SUM(matches), 0)')} AS strike_rate,
       CAST(SUM(matches) AS BIGINT) AS matches_played
FROM monthly GROUP BY player_id, year, (month - 1) // 3 + 1, format""",
    "i12c_rejected_lines": f"""
SELECT player_id, match_id, format, line_number, fault,
       CAST(CASE WHEN fault = '' THEN CASE WHEN runs % 7 = 0 THEN 1234 ELSE runs END END AS BIGINT) AS runs_conceded
FROM ({_FAULTS})""",
    "r10_load_reports": f"""
WITH f AS ({_FAULTS})
SELECT CAST(run AS BIGINT) AS run, 'players' AS table_name,
       CASE run WHEN 1 THEN COUNT(DISTINCT player_id) FILTER (WHERE fault = '') ELSE 0 END AS inserted,
       CAST(0 AS BIGINT) AS rejected
FROM f, (SELECT unnest([1, 2]) AS run) r GROUP BY run
UNION ALL
SELECT run, 'bowling_stats', CASE run WHEN 1 THEN COUNT(*) FILTER (WHERE fault = '') ELSE 0 END,
       COUNT(*) FILTER (WHERE fault <> '') FROM f, (SELECT unnest([1, 2]) AS run) r GROUP BY run""",
    "r03_read_documents": """
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'bad' ELSE 'good' END AS kind,
       CAST((SELECT COUNT(*) FROM events WHERE event_id % 10 = 0) AS BIGINT) AS rejected FROM events""",
    "r09_create_and_append": " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, CAST({'(SELECT COUNT(*) FROM teams)' if n == 'teams' else 0} AS BIGINT) AS stored_rows"
        for n in TABLE_DDL),
    "i01b_first_present": """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type WHEN event_id % 3 = 0 THEN 'third' END AS found FROM events""",
    "i10b_missing_members": """
SELECT DISTINCT o_custkey AS player_id, 'Unknown' AS full_name, 'Unknown' AS country, 'Unknown' AS playing_role,
       'Unknown' AS batting_style, 'Unknown' AS bowling_style
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_custkey NOT IN (SELECT player_id FROM players WHERE player_id % 2 = 1)""",
    "i09c_consecutive_ids": """
SELECT CAST(ROW_NUMBER() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                               l_shipdate) AS BIGINT) AS id, l_orderkey, l_partkey, l_suppkey FROM lineitem""",
    "c1b_check_all_keys": _keys_sql(),
    "c3b_check_all_widths": _widths_sql(),
    "c3c_check_castable": "SELECT c_custkey, c_name AS code FROM customer WHERE c_custkey % 3 = 0",
    # one statement after the other, each on the table that the one before left
    "c5_apply_many_changes": f"""
WITH {_STATEMENTS}
SELECT * FROM t11""",
    "c4b_rejected_changes": f"""
WITH {_STATEMENTS}
SELECT player_id, 'I' AS op, 'duplicate key' AS reason FROM t3 WHERE player_id % 7 = 0 AND player_id < 10000000
UNION ALL SELECT player_id, 'I', 'invalid row' FROM players
  WHERE player_id % 7 = 0 AND player_id <= 0 AND player_id NOT IN (SELECT player_id FROM t3)
UNION ALL SELECT player_id + 10000000, 'I', 'invalid row' FROM players WHERE player_id % 4 = 2
UNION ALL SELECT -player_id, 'I', 'invalid row' FROM players WHERE player_id % 4 = 3
UNION ALL SELECT player_id, 'I', 'duplicate key' FROM t10 WHERE player_id > 10000000 AND (player_id - 10000000) % 64 = 1""",
    "b2b_squad_lists": """
WITH s AS (
  SELECT l_orderkey, l_linestatus = 'F' AS plays, string_agg(s_name, ';' ORDER BY l_linenumber, l_suppkey) AS names
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
SELECT l_orderkey AS "matchId", CASE WHEN plays THEN 'playing XI' ELSE 'bench' END AS "group",
       CASE WHEN plays THEN names ELSE names || ';' || names END AS names FROM s""",
    "b3b_ranking_list": """
SELECT * FROM (
  SELECT CAST(ROW_NUMBER() OVER (PARTITION BY c_custkey // 10 ORDER BY c_custkey) AS BIGINT) AS position,
         c_custkey AS id, c_name AS name, n_name AS country, CAST(FLOOR(c_acctbal) AS DOUBLE) AS rating
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 1)
WHERE position <= 15""",
    "q19b_consistent_from_states": ORACLE_QUERIES["q19_consistent_batsmen"],
    "q19c_consistent_from_a_broken_month": ORACLE_QUERIES["q19_consistent_batsmen"].replace("1996-01-01", "1996-01-17"),
    "q25b_trend_from_states": ORACLE_QUERIES["q25_quarterly_trend"],
    "q20c_matches_by_sketch": """
SELECT player_id, CAST(COUNT(DISTINCT match_id) AS BIGINT) AS matches_played, true AS near
FROM batting_stats GROUP BY player_id""",
    "st1b_events_in_batches": _FIRST_VERSIONS,
    "st1c_events_by_keyed_state": _FIRST_VERSIONS,
    "r04_kept_rejects": f"""
SELECT 'document' AS kind, 'not a JSON object' AS reason, event_id AS id, NULL AS player_id, NULL AS format,
       NULL AS line_number
FROM events WHERE event_id % 10 = 0
UNION ALL
SELECT 'line', fault, match_id, player_id, format, line_number FROM ({_FAULTS}) WHERE fault <> ''""",
}


def load_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def norm(fn):
        def run(spark: SparkSession, d: str) -> DataFrame:
            return normalize_types(fn(spark, d))
        run.__name__ = fn.__name__
        return run
    return {k: norm(v) for k, v in _QUERIES.items()}


def load_oracles() -> dict[str, str]:
    return {k: with_tables(sql) for k, sql in _ORACLES.items()}
