"""Helpers shared by the training-data operators.

Scratch data goes to the folder that the cluster names in
``spark.checkpoint.dir`` (see :func:`crease.session.ensure_checkpoint_dir`);
every call uses a folder of its own, so a rerun never reads another run's rows.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.session import ensure_checkpoint_dir


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application (as ``--py-files`` would)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="run-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name (not yet created) under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, **options) -> tuple[DataFrame, str]:
    """Write ``df`` once to shared Parquet; return it read back, and its folder.

    Cuts the lineage at files that survive lost executors.
    """
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch folders made by :func:`scratch` that no result reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shared_fs(path: str):
    """pyarrow file system and path of a folder that all executors share."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def held_remainder(doc_id: str, parts: int):
    """crc32 of doc_id as text, modulo ``parts`` (null for a null doc_id)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def whole_rows(docs: DataFrame, text: str, *more):
    """The rows as struct ``doc`` beside ``more``, and a function that gives a record batch's texts.

    The text travels once: a text column is read from the struct, one of another
    type is cast and sent beside it.
    """
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    if dict(docs.dtypes)[text] == "string":
        at = docs.columns.index(text)
        return docs.select(doc, *more), lambda batch: batch.column(0).field(at)
    return docs.select(doc, *more, F.col(text).cast("string").alias("_text")), \
        lambda batch: batch.column(batch.num_columns - 1)
