"""Upserts by touched partitions, refreshed summaries and quarters, key checks that leave the store in place."""

import json
import os
import random

import pytest

from crease.operators import ingest as I
from crease.operators.keys import met_rows, new_rows
from crease.operators.upsert import upsert_rows
from crease.sources.documents import parse_documents
from crease.sources.schemas import doc_schema
from crease.sources.tables import create_tables, load_table


def files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def careers(spark, stats_by_player, order=None):
    rows = [(json.dumps({"playerId": str(p), "kind": "batting", "stats": s}),) for p, s in stats_by_player]
    df = spark.createDataFrame(rows, "value string").coalesce(1)
    return parse_documents(df, "value", doc_schema("career"), with_order=order is None)[0]


def no_cards(spark):
    empty = spark.createDataFrame([], "value string")
    return parse_documents(empty, "value", doc_schema("detailed_scorecard"))[0]


def test_upsert_replaces_rows_and_only_touched_parts(spark, tmpdir_path):
    def put(rows):
        r = upsert_rows(spark.createDataFrame(rows, "k bigint, g string, v int"), tmpdir_path, "t", ["k", "g"], parts=8)
        return r.inserted, r.updated, r.skipped

    def stored():
        return sorted(((r.k, r.g, r.v) for r in spark.read.parquet(f"{tmpdir_path}/t").collect()),
                      key=lambda r: tuple((x is None, x) for x in r))

    first = [(k, "a", k) for k in range(40)] + [(None, None, 1)]
    assert put(first) == (41, 0, 0)
    before = files(f"{tmpdir_path}/t")
    assert put([(3, "a", 3), (None, None, 1)]) == (0, 0, 2)      # nothing differs: no file is touched
    assert files(f"{tmpdir_path}/t") == before
    assert put([(3, "a", 300), (None, None, 2), (41, None, 5)]) == (1, 2, 0)
    want = {(k, g): v for k, g, v in first} | {(3, "a"): 300, (None, None): 2, (41, None): 5}
    assert {(k, g): v for k, g, v in stored()} == want and len(stored()) == 42
    after = files(f"{tmpdir_path}/t")
    assert 1 <= len({os.path.dirname(f) for f in before - after}) <= 3 and before & after


def test_upsert_takes_over_tables_of_another_layout(spark, tmpdir_path):
    spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k bigint, g string, v int").write.parquet(f"{tmpdir_path}/t")
    new = spark.createDataFrame([(2, "b", 20), (3, "c", 3)], "k bigint, g string, v int")
    report = upsert_rows(new, tmpdir_path, "t", ["k"], parts=4)
    assert (report.inserted, report.updated) == (1, 1)
    upsert_rows(new.where("k = 3"), tmpdir_path, "t", ["k"], parts=16)  # the stored number of parts holds
    rows = spark.read.parquet(f"{tmpdir_path}/t").collect()
    assert sorted((r.k, r.v) for r in rows) == [(1, 1), (2, 20), (3, 3)]
    create_tables(spark, tmpdir_path, ["player_format_summary"])
    empty = load_table(spark, tmpdir_path, "player_format_summary")
    assert upsert_rows(empty, tmpdir_path, "player_format_summary", ["player_id", "format"]).inserted == 0
    assert load_table(spark, tmpdir_path, "player_format_summary").columns == empty.columns


def test_second_ingest_refreshes_summaries_and_completes_quarters(spark, tmpdir_path):
    def stat(runs, *months):
        return [{"format": "ODI", "runs": str(runs), "timeline": [
            {"year": "2024", "month": str(m), "runs": str(r), "strikeRate": "80.00", "matches": "1"} for m, r in months]}]

    none = careers(spark, [])
    I.ingest_all(no_cards(spark), careers(spark, [(1, stat(100, (1, 10), (2, 20))), (2, stat(7, (5, 3)))]), none,
                 tmpdir_path, parts=4)
    reports = {r.table: r for r in I.ingest_all(
        no_cards(spark), careers(spark, [(1, stat(250, (3, 30)))]), none, tmpdir_path, parts=4)}
    summary = {r.player_id: r.total_runs for r in load_table(spark, tmpdir_path, "player_format_summary").collect()}
    assert summary == {1: 250, 2: 7}
    quarters = {(r.player_id, r.quarter): (r.total_runs, r.matches_played)
                for r in load_table(spark, tmpdir_path, "player_quarterly_stats").collect()}
    assert quarters == {(1, 1): (60, 3), (2, 2): (3, 1)}
    assert reports["player_format_summary"].updated == reports["player_quarterly_stats"].updated == 1


def test_summary_pick_follows_document_order_not_row_order(spark):
    docs = [(9, [{"format": "ODI", "runs": "1"}, {"format": "ODI", "runs": "2"}]), (9, [{"format": "ODI", "runs": "3"}]),
            (9, [{"format": "ODI", "runs": "100"}, {"format": "Test", "runs": "5"}])]
    df, none = careers(spark, docs), careers(spark, [])
    assert len({r._doc_order for r in df.collect()}) == 3
    for seed in range(4):
        shuffled = spark.createDataFrame(random.Random(seed).sample(df.collect(), 3), df.schema).repartition(3)
        got = {r.format: r.total_runs for r in I.merge_format_summary(shuffled, none).collect()}
        assert got == {"ODI": 100, "Test": 5}
    bare = careers(spark, docs, order=False)  # no document order: by position, then values
    assert {r.format: r.total_runs for r in I.merge_format_summary(bare, none).collect()} == {"ODI": 2, "Test": 5}


def ancestors_of_scan(plan, where):
    """Operators above the scan of a path, from a plan's text."""
    stack, out = [], None
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        name = line.strip(" :+-*")
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, name))
        if where in line:
            out = [n for _, n in stack[:-1]]
    return out


@pytest.mark.parametrize("null_safe", [False, True])
def test_small_load_leaves_the_stored_table_unshuffled(spark, tmpdir_path, null_safe):
    spark.range(200_000).selectExpr("id as big_k", "repeat('x', 50) as v").withColumnRenamed("big_k", "k") \
        .write.parquet(f"{tmpdir_path}/stored_big")
    spark.createDataFrame([(5, "a"), (300_000, "b"), (None, "c")], "k bigint, w string").write.parquet(f"{tmpdir_path}/few")
    big, few = spark.read.parquet(f"{tmpdir_path}/stored_big"), spark.read.parquet(f"{tmpdir_path}/few")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        df = new_rows(few, big, ["k"], null_safe=null_safe)
        assert sorted(r.w for r in df.collect()) == ["b", "c"]
        above = ancestors_of_scan(df._jdf.queryExecution().executedPlan().toString(), "stored_big")
        join = [k for k, n in enumerate(above) if n.startswith("BroadcastHashJoin") and "LeftSemi" in n]
        assert join and not any("Exchange hashpartitioning" in n for n in above[join[0]:])
        assert met_rows(big, few, ["k"]).count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
