"""Rejected input is kept, loaded files are skipped, document order does not depend on splits; keyed stream state."""

import json
import os

from crease import load
from crease.operators import loads as L
from crease.sources import documents
from crease.sources.documents import read_documents, stage_documents
from crease.sources.ledger import LEDGER, new_files
from crease.sources.schemas import doc_schema
from crease.sources.sinks import rejects_path
from crease.streaming.incremental import keyed_load, run_incremental_load

CARD = {"matchId": "1", "scorecard": [{"batsman": [], "bowler": [
    {"id": "5", "name": "P", "overs": "2", "runs": "abc", "wickets": "1", "econ": "3.0"},
    {"id": "6", "name": "Q", "overs": "2", "runs": "7", "wickets": "0", "econ": "3.5"}]}]}


def land(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def test_load_keeps_rejects_and_skips_loaded_files(spark, tmpdir_path, monkeypatch):
    landing, tables = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "t")
    land(landing, "a.json", [json.dumps(CARD), "{not json", ""])
    opened = []
    real = documents.read_text_documents
    monkeypatch.setattr(documents, "read_text_documents", lambda s, path, m=False: opened.append(path) or real(s, path, m))

    def run(**kw):
        return {r["table"]: (r["inserted"], r["rejected"]) for r in load.run(spark, "bowling", landing, tables, **kw)}

    assert run() == {"players": (1, 1), "bowling_stats": (1, 2)}
    docs = spark.read.parquet(rejects_path(tables, "documents-bowling")).collect()
    assert [(r.reason, r.raw, os.path.basename(r.file), r.block) for r in docs] == [
        ("not a JSON object", "{not json", "a.json", 0)]
    lines = spark.read.parquet(rejects_path(tables, "bowling_stats")).collect()
    assert [(r.reason, json.loads(r.raw)["player_id"]) for r in lines] == [("runs_conceded", 5)]
    assert run() == {"players": (0, 0), "bowling_stats": (0, 0)} and len(opened) == 1
    # read again all the same: nothing is stored or rejected twice
    assert run(ledger=False)["bowling_stats"] == (0, 2) and len(opened) == 2
    assert spark.read.parquet(rejects_path(tables, "bowling_stats")).count() == 1
    assert spark.read.parquet(rejects_path(tables, "documents-bowling")).count() == 1
    land(landing, "b.json", [json.dumps({**CARD, "matchId": "2"})])
    assert [os.path.basename(r.path) for r in new_files(spark, landing, "bowling", tables).collect()] == ["b.json"]
    assert run() == {"players": (0, 0), "bowling_stats": (1, 1)} and len(opened[-1]) == 1
    land(landing, "a.json", [json.dumps(CARD)])  # a changed file is new again
    assert run()["bowling_stats"] == (0, 1)
    assert spark.read.parquet(os.path.join(tables, LEDGER)).count() == 3


def test_kept_rows_do_not_depend_on_splits(spark, tmpdir_path):
    lines = [json.dumps({"players": [{"id": str(k % 40), "name": f"name {k:04}"}]}) for k in range(400)]
    land(tmpdir_path, "p.json", lines)
    kept = []
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("300", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            docs, _ = read_documents(spark, tmpdir_path, doc_schema("player_lists"), with_order=True)
            parts = docs.rdd.getNumPartitions()
            players = L.I.extract_players(L.I.collect_entries(docs, L.PLAYER_LIST_KEYS), "X")
            kept.append(sorted((r.player_id, r.full_name) for r in players.collect()))
            assert (parts > 10) == (size == "300")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert kept[0] == kept[1] == [(k, f"name {k:04}") for k in range(40)]


def test_stage_documents_without_any(spark, tmpdir_path):
    land(tmpdir_path, "empty.json", [""])
    good, rejected, _ = stage_documents(spark, tmpdir_path, doc_schema("scorecard"))
    assert (good.count(), rejected.count()) == (0, 0)


def test_keyed_state_equals_one_load_after_a_restart_too(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "src")
    df = spark.range(300).selectExpr("id % 50 as k", "cast(297 - id as int) as version", "concat('v', id) as v")

    def write(part, some):
        df.where(some).repartition(3).write.parquet(os.path.join(src, part))

    def follow(files, target):
        q = keyed_load(spark, os.path.join(src, "*"), df.schema, target, ["k"], ["version"], f"{target}-ckpt",
                       max_files_per_trigger=files, every=None, parts=4)
        q.awaitTermination()
        assert q.exception() is None
        return sorted((r.k, r.version, r.v) for r in spark.read.parquet(target).collect())

    targets = {n: os.path.join(tmpdir_path, f"keyed-{n}") for n in (1, 1000)}
    write("a", "id < 120")
    first = {n: follow(n, t) for n, t in targets.items()}
    assert first[1] == first[1000] and len(first[1]) == 50
    write("b", "id >= 120")
    again = {n: follow(n, t) for n, t in targets.items()}  # a new query over the old checkpoint
    one = os.path.join(tmpdir_path, "one")
    run_incremental_load(spark, os.path.join(src, "*"), df.schema, one, ["k"], ["version"])
    want = sorted((r.k, r.version, r.v) for r in spark.read.parquet(one).collect())
    assert again[1] == again[1000] == want and want != first[1]
