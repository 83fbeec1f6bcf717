"""Spark session defaults for this library.

Everything here is ordinary Spark configuration.  `get_session` builds a
session with these defaults (on an existing session Spark applies the SQL
options of the builder as well); the session time zone is always pinned to
UTC because epoch conversions depend on it.  The checkpoint folder is only
read from the cluster's `spark.checkpoint.dir`, and created locally only
when that is unset (tests).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every plan in this library relies on.  The time zone is pinned so
# epoch-millisecond -> date conversions are reproducible.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "crease",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Return the active session, or build one with this library's defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    # getOrCreate may hand back an existing session: pin the SQL settings anyway.
    for k in ("spark.sql.session.timeZone",):
        spark.conf.set(k, conf[k])
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The cluster names it in ``spark.checkpoint.dir``; we only read it.  In
    local mode, where one machine runs everything, a fresh scratch folder is
    created when it is unset; on a cluster that is an error, as executors
    would write to folders that nobody else sees.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="run-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name (not yet created) under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


SMALL_LOAD = 10 << 20  # bytes of a load's files whose keys Spark broadcasts by default


def is_small(df: DataFrame) -> bool:
    """Whether the files that `df` reads hold so little that its keys rather meet a stored table by broadcast."""
    spark, total = df.sparkSession, 0
    for name in df.inputFiles():
        where = spark._jvm.org.apache.hadoop.fs.Path(name)
        total += where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).getLen()
        if total > SMALL_LOAD:
            return False
    return True


def file_bytes(df: DataFrame) -> int:
    """Bytes of the files that `df` reads."""
    spark, total = df.sparkSession, 0
    for name in df.inputFiles():
        where = spark._jvm.org.apache.hadoop.fs.Path(name)
        total += where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).getLen()
    return total


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that no result reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
