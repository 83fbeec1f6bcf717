"""Steps that grow with the tables: what they read, exchange and hold, and that their rows are whole."""

import json

from pyspark.sql import functions as F

from conftest import SF_SMALL
from crease.operators import ingest as I
from crease.operators.keys import dedupe_all, ensure_members, fresh_rows, new_rows
from crease.operators.search_index import name_trigrams
from crease.operators.upsert import in_parts, upsert_rows
from crease.plans import nesting as N
from crease.sources.fixtures import fixture_tables


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df.select("*")._jdf.queryExecution().executedPlan().toString()  # as planned, whether it has run or not


def test_fresh_rows_are_the_first_of_each_new_key_with_one_exchange_a_side(spark):
    rows = spark.createDataFrame([(1, "a", 5, "x"), (1, "a", 3, "y"), (2, None, 1, "z"), (None, "c", 2, None), (4, "d", 1, "w")],
                                 "k bigint, g string, v int, w string")
    there = spark.createDataFrame([(2, None), (4, "e"), (4, "e")], "k bigint, g string")
    want = sorted(map(str, new_rows(dedupe_all(rows, ["k", "g"]), there, ["k", "g"], null_safe=True).collect()))
    got = fresh_rows(rows, there, ["k", "g"])
    assert sorted(map(str, got.collect())) == want and len(want) == 3 and got.columns == rows.columns
    assert physical(got).count("Exchange hashpartitioning") == 1  # rows and stored keys united before it


def test_career_documents_read_lines_once(spark):
    docs = N.batting_career_docs(spark, SF_SMALL)
    assert plan(docs).count("l_returnflag") and physical(docs).count("lineitem.parquet") == 1
    assert physical(N.detailed_docs(fixture_tables(spark, SF_SMALL))).count("lineitem.parquet") == 1


def test_career_documents_hold_the_summary(spark):
    texts = N.career_texts(spark, SF_SMALL).collect()
    got = {}
    for r in texts:
        bat, bowl = json.loads(r.batting), json.loads(r.bowling)
        for b, w in zip(bat["stats"], bowl["stats"], strict=True):
            assert b["format"] == w["format"] and sum(int(t["runs"]) for t in b["timeline"]) == int(b["runs"])
            got[int(bat["playerId"]), b["format"]] = (b["runs"], b.get("average"), b.get("strikeRate"), b["hundreds"],
                                                      b["matches"], b["innings"], w["wickets"], w.get("average"),
                                                      w.get("economyRate"))
    text = lambda x: None if x is None else str(x)
    want = {(r.player_id, r.format): tuple(map(text, (
        r.total_runs, r.batting_average, r.strike_rate, r.centuries, r.matches_played, r.innings_played, r.total_wickets,
        r.bowling_average, r.economy_rate))) for r in fixture_tables(spark, SF_SMALL)["player_format_summary"].collect()}
    assert got == want


def test_an_order_of_two_months_counts_once(spark, tmpdir_path):
    spark.sql("""SELECT * FROM VALUES (1, 7, 1, 1, 10D, 10D, 'A', 'F', timestamp'1999-01-05'), (1, 7, 1, 2, 20D, 10D, 'A', 'F',
        timestamp'1999-01-05'), (2, 8, 1, 1, 5D, 10D, NULL, 'F', timestamp'1999-01-05') AS t(l_orderkey, l_partkey, l_suppkey,
        l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_shipdate)""") \
        .write.parquet(f"{tmpdir_path}/lineitem.parquet")
    spark.sql("""SELECT * FROM VALUES (1, 3, timestamp'1999-01-05'), (1, 3, timestamp'1999-02-05'), (2, 3, timestamp'1999-02-05')
        AS t(o_orderkey, o_custkey, o_orderdate)""").write.parquet(f"{tmpdir_path}/orders.parquet")
    rows = N.career_texts(spark, tmpdir_path).collect()
    assert len(rows) == 1
    bat, bowl = json.loads(rows[0].batting)["stats"], json.loads(rows[0].bowling)["stats"]
    test = next(s for s in bat if s.get("format") == "Test")
    assert (test["matches"], test["innings"], test["runs"]) == ("1", "4", "180")
    assert [(t["month"], t["matches"]) for t in test["timeline"]] == [("1", "1"), ("2", "1")]
    # without a format nothing matches: a batting entry and a bowling entry, as the full join of the sides gives them
    assert sorted((s["runs"], s["innings"]) for s in bat if "format" not in s) == [("0", "0"), ("15", "1")]
    assert sorted(s["wickets"] for s in bowl if "format" not in s) == ["0", "1"]


def test_stub_members_read_the_facts_once(spark, tmpdir_path):
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "player_id bigint, full_name string").write.parquet(f"{tmpdir_path}/facts")
    facts = spark.read.parquet(f"{tmpdir_path}/facts")
    dim = spark.createDataFrame([(2,)], "player_id bigint")
    out = ensure_members(facts, dim, "player_id", name_col="full_name")
    assert [(r.player_id, r.full_name) for r in out.collect()] == [(1, "a")]
    assert physical(out).count(f"{tmpdir_path}/facts") == 1


def test_trigrams_are_not_grouped(spark):
    players = spark.createDataFrame([(1, "Abcabc"), (1, "bcd"), (2, "ab"), (3, None)], "player_id bigint, full_name string")
    index = name_trigrams(players)
    assert sorted((r.trigram, r.player_id) for r in index.collect()) == [("abc", 1), ("bca", 1), ("bcd", 1), ("cab", 1)]
    p = plan(index)
    assert p.index("Generate") < p.index("Aggregate [player_id")  # the names are grouped, below


def test_first_upsert_writes_in_one_pass_and_an_equal_one_changes_nothing(spark, tmpdir_path):
    rows = spark.createDataFrame([(k, k % 3, k) for k in range(30)] + [(None, 1, 5)], "k bigint, g int, v bigint")
    laid = in_parts(rows, ["k"], 4).groupBy("_part", "k", "g").agg({"v": "sum"}).drop("_part").withColumnRenamed("sum(v)", "v")
    assert physical(laid).count("Exchange") == 1
    report = upsert_rows(laid, tmpdir_path, "t", ["k", "g"], part_keys=["k"], parts=4, arranged=True)
    assert (report.inserted, report.updated) == (31, 0)
    again = upsert_rows(rows, tmpdir_path, "t", ["k", "g"], part_keys=["k"], parts=4)
    assert (again.inserted, again.updated, again.skipped) == (0, 0, 31)


def test_quarters_of_told_months_only(spark):
    months = "player_id bigint, format string, year int, quarter int, month int, runs bigint, weighted_sr decimal(38,2), matches bigint"
    rows = [(1, "ODI", 2024, 1, 1, 10, 80, 1), (1, "ODI", 2024, 1, 2, 20, 80, 1), (1, "ODI", 2024, 2, 4, 7, 80, 1),
            (None, "ODI", 2024, 1, 1, 3, 80, 1)]
    states = spark.createDataFrame(rows, months.replace("decimal(38,2)", "int")) \
        .withColumn("weighted_sr", F.col("weighted_sr").cast("decimal(38,2)"))
    told = states.where("month = 2 OR player_id IS NULL")
    got = sorted(((r.player_id, r.total_runs, r.matches_played) for r in I.quarters_of(states, told).collect()), key=str)
    assert got == [(1, 30, 2), (None, 3, 1)]
