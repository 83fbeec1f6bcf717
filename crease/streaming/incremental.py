"""Incremental insert-if-absent loading with Structured Streaming (ST1).

The source re-runs a batch script that appends only rows whose key is not
stored yet.  Here a file-source stream does the same in two steps.  Every
micro-batch is deduplicated on the key (I7) and written under its own number
next to the checkpoint, so a batch replayed after a failure replaces itself.
:func:`merge_staged` then keeps the first row by `order_by` of every key over
all staged batches, drops keys that are stored already (I8), and appends the
rest.  The rows of a run therefore do not depend on how its files fell into
batches; a key that an earlier run has stored keeps its stored row.  Merging
again adds nothing, so a failure before the staged batches are dropped does
no harm.  The checkpoint records which files were consumed.

:func:`keyed_load` is the continuous form.  The stream's state store holds the
kept row of every key; a batch changes the state of its own keys only and gives
the rows whose kept row is new or smaller than before, which are upserted into
the few partitions of the target that they fall into.  No batch reads the whole
target, and the stored rows are those of one load over all files seen since the
checkpoint began, however the files fell into batches and whenever the stream
was stopped and started.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from crease.operators.keys import dedupe, new_rows
from crease.operators.upsert import DEFAULT_PARTS, upsert_rows
from crease.session import delete_folder
from crease.sources.tables import path_exists

# Files per micro-batch: bounds every batch, including the first one.
DEFAULT_MAX_FILES_PER_TRIGGER = 1000

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def staging_folder(checkpoint: str) -> str:
    return f"{checkpoint.rstrip('/')}-staged"


def merge_staged(spark: SparkSession, schema: StructType, target: str, keys: Sequence[str],
                 order_by: Sequence[str], checkpoint: str) -> None:
    """Append the staged batches' new keys to `target`, then drop the staged batches."""
    staged = staging_folder(checkpoint)
    if not path_exists(spark, staged):
        return
    fresh = dedupe(spark.read.schema(schema).parquet(f"{staged}/batch=*"), list(keys), order_by)
    if path_exists(spark, target):
        fresh = new_rows(fresh, spark.read.schema(schema).parquet(target), list(keys))
    fresh.write.mode("append").parquet(target)
    delete_folder(spark, staged)


def incremental_load(spark: SparkSession, source: str, schema: StructType, target: str,
                     keys: Sequence[str], order_by: Sequence[str], checkpoint: str,
                     fmt: str = "parquet", glob: str | None = None,
                     max_files_per_trigger: int | None = DEFAULT_MAX_FILES_PER_TRIGGER,
                     available_now: bool = True) -> StreamingQuery:
    """Start the load.

    With `available_now=True` it stages what is there and stops;
    :func:`merge_staged` makes the rows visible (see `run_incremental_load`).
    A continuous load (`available_now=False`) is a :func:`keyed_load`.
    """
    if not available_now:
        return keyed_load(spark, source, schema, target, keys, order_by, checkpoint, fmt, glob, max_files_per_trigger)
    stream = _files(spark, source, schema, fmt, glob, max_files_per_trigger)
    keys = list(keys)

    def load_batch(batch: DataFrame, epoch: int) -> None:
        dedupe(batch, keys, order_by).write.mode("overwrite").parquet(f"{staging_folder(checkpoint)}/batch={epoch}")

    return stream.writeStream.foreachBatch(load_batch).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()


def _files(spark: SparkSession, source: str, schema: StructType, fmt: str, glob: str | None,
           max_files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(source)


def keyed_load(spark: SparkSession, source: str, schema: StructType, target: str, keys: Sequence[str],
               order_by: Sequence[str], checkpoint: str, fmt: str = "parquet", glob: str | None = None,
               max_files_per_trigger: int | None = DEFAULT_MAX_FILES_PER_TRIGGER, every: str | None = "30 seconds",
               parts: int = DEFAULT_PARTS) -> StreamingQuery:
    """Start a load whose kept row per key (the first by `order_by`) lives in the state store.

    The state is a streaming aggregate: rows of a batch are combined map-side
    before they meet their key's state, so a hot key is no hot task.  `target`
    is stored in hash parts of the keys (see `upsert_rows`); a batch replayed
    after a failure gives the same rows and changes nothing.  `every=None`
    processes what is there and stops.  State is kept on the executors' disks
    (RocksDB), so that keys need not fit the heap, unless the session names
    another state store; a checkpoint keeps the store that it began with.
    """
    keys = list(keys)
    rest = [c for c in schema.fieldNames() if c not in keys]
    stream = _files(spark, source, schema, fmt, glob, max_files_per_trigger)
    kept = stream.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order_by)).alias("_first"))
    folder, name = os.path.split(target.rstrip("/"))

    def put(batch: DataFrame, epoch: int) -> None:
        rows = batch.select(*keys, *[F.col(f"_first.`{c}`").alias(c) for c in rest]).select(*schema.fieldNames())
        upsert_rows(rows, folder, name, keys, parts=parts)

    w = kept.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=every) if every else w.trigger(availableNow=True)
    if spark.conf.get(STATE_STORE, None) is not None:
        return w.start()
    spark.conf.set(STATE_STORE, ON_DISK)  # a stream keeps the settings that it is started with
    try:
        return w.start()
    finally:
        spark.conf.unset(STATE_STORE)


def run_incremental_load(spark: SparkSession, source: str, schema: StructType, target: str,
                         keys: Sequence[str], order_by: Sequence[str], checkpoint: str | None = None,
                         **kw) -> None:
    """Run one `available_now` load to completion, merge included."""
    checkpoint = checkpoint or f"{target}_checkpoint"
    q = incremental_load(spark, source, schema, target, keys, order_by, checkpoint, **kw)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    merge_staged(spark, schema, target, keys, order_by, checkpoint)
