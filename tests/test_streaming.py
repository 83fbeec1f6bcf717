"""Incremental load: reruns add nothing, new files add only new keys."""

import os

from crease.streaming.incremental import run_incremental_load


def test_incremental_load_is_idempotent(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "src")
    df = spark.range(0, 100).selectExpr("id AS event_id", "id % 7 AS v")
    df.where("event_id < 60").write.parquet(os.path.join(src, "a"))
    target = os.path.join(tmpdir_path, "target")
    ckpt = os.path.join(tmpdir_path, "ckpt")
    schema = df.schema
    run_incremental_load(spark, os.path.join(src, "*"), schema, target, ["event_id"], ["v"], checkpoint=ckpt)
    assert spark.read.parquet(target).count() == 60
    run_incremental_load(spark, os.path.join(src, "*"), schema, target, ["event_id"], ["v"], checkpoint=ckpt)
    assert spark.read.parquet(target).count() == 60
    # overlapping new file: only the 40 unseen keys are appended
    df.where("event_id >= 50").write.parquet(os.path.join(src, "b"))
    run_incremental_load(spark, os.path.join(src, "*"), schema, target, ["event_id"], ["v"], checkpoint=ckpt)
    out = spark.read.parquet(target)
    assert out.count() == 100 and out.select("event_id").distinct().count() == 100
