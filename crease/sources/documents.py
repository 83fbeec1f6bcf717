"""JSON document sources (R3, R4, R4b) and the relational connector.

Landed JSON files replace the source's HTTP calls: one document per line
(or per file with `multi_line=True`).  Documents are parsed against an
explicit schema; malformed ones are split off instead of failing the load
(`on_error="skip"`), or abort it (`on_error="fail"`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from crease.session import shared_folder

CORRUPT = "_corrupt_record"


def _with_corrupt(schema: StructType) -> StructType:
    if CORRUPT in schema.fieldNames():
        return schema
    return StructType(list(schema.fields) + [StructField(CORRUPT, StringType(), True)])


def _options(on_error: str) -> dict[str, str]:
    if on_error == "fail":
        return {"mode": "FAILFAST"}
    if on_error == "skip":
        return {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    raise ValueError(f"on_error must be 'skip' or 'fail', not {on_error!r}")


def parse_json_column(text: Column | str, schema: StructType, on_error: str = "skip") -> Column:
    """`from_json` with the corrupt-record column added in skip mode."""
    col = F.col(text) if isinstance(text, str) else text
    s = _with_corrupt(schema) if on_error == "skip" else schema
    return F.from_json(col, s, _options(on_error))


DOC_ORDER = "_doc_order"


def parse_documents(df: DataFrame, text_col: str, schema: StructType, on_error: str = "skip",
                    keep: list[str] | None = None, with_order: bool = False,
                    observe: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """Parse a column of JSON text into top-level columns.

    Returns (documents, rejected).  `rejected` keeps the raw text of documents
    that were not JSON objects (the source logs and skips those); NULL text
    is treated as a missing document and dropped.

    `with_order=True` adds `_doc_order`, increasing in input order (partition,
    then row), for "keep the first occurrence" rules downstream.  For landed
    files `read_documents` has an order that does not depend on the splits.

    `observe` counts the rejected documents (metric `rejected`) while a later
    action parses them anyway, so no extra pass is needed.
    """
    keep = list(keep or [])
    if with_order:
        df = df.withColumn(DOC_ORDER, F.monotonically_increasing_id())
        keep.append(DOC_ORDER)
    parsed = df.select(*keep, F.col(text_col).alias("_text"),
                       parse_json_column(text_col, schema, on_error).alias("_doc"))
    parsed = parsed.filter(F.col("_text").isNotNull())
    if on_error == "fail":
        return parsed.select(*keep, "_doc.*"), parsed.limit(0).select(*keep, "_text")
    bad = F.col(f"_doc.{CORRUPT}").isNotNull()
    if observe is not None:
        parsed = parsed.observe(observe, F.count(F.when(bad, 1)).alias("rejected"))
    good = parsed.filter(~bad).select(*keep, *[F.col(f"_doc.`{n}`").alias(n) for n in schema.fieldNames()])
    rejected = parsed.filter(bad).select(*keep, F.col("_text").alias("raw"))
    return good, rejected


DOC_FILE, DOC_BLOCK = "_doc_file", "_doc_block"


def read_text_documents(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """The text of landed documents, one a row (column `value`), with their place.

    `_doc_file` and `_doc_block` are the file and the first byte of its split;
    `_doc_order` orders documents by the file's modification time, its path,
    the split and the row in the split.  Splits of a file follow each other, so
    the order of any two documents is the same under all split settings.
    """
    text = spark.read.option("wholetext", str(multi_line).lower()).text(path)
    meta = F.col("_metadata")
    text = text.select("value", meta["file_path"].alias(DOC_FILE), meta["file_block_start"].alias(DOC_BLOCK),
                       F.struct(meta["file_modification_time"].alias("modified"), meta["file_path"].alias("file"),
                                meta["file_block_start"].alias("block"),
                                F.monotonically_increasing_id().alias("row")).alias(DOC_ORDER))
    return text if multi_line else text.where(F.trim(F.col("value")) != "")


def read_documents(spark: SparkSession, path: str | list[str], schema: StructType, on_error: str = "skip",
                   multi_line: bool = False, with_order: bool = False,
                   observe: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """Read landed JSON documents with an explicit schema.

    Returns (documents, rejected) like `parse_documents`.  Files are read as
    text: line-delimited files split across tasks, one document per line;
    `multi_line=True` reads one document per file.  Parsing is `from_json`
    against the explicit schema, never inference.  `with_order=True` adds
    `_doc_order` (see `read_text_documents`).
    """
    text = read_text_documents(spark, path, multi_line)
    return parse_documents(text, "value", schema, on_error, keep=[DOC_ORDER] if with_order else None, observe=observe)


def variant_fields(df: DataFrame, doc: str) -> DataFrame:
    """The other columns of `df`, and key and value (text) of every field of its documents.

    `doc` is JSON text or a VARIANT; keys need not be known before.  Nested
    values are JSON text; a document that is no JSON object has no fields.
    """
    if dict(df.dtypes)[doc] == "string":
        df = df.withColumn(doc, F.try_parse_json(doc))
    rest = [F.col(f"`{c}`") for c in df.columns if c != doc]
    packed = df.select(F.struct(*rest).alias("_rest"), F.col(doc).alias("_doc"))
    spread = packed.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_doc").outer()).alias("f"))
    text = F.coalesce(F.try_variant_get("f.value", "$", "string"), F.to_json("f.value"))
    return spread.where("f.key is not null").select("_rest.*", "f.key", text.alias("value"))


def variant_numbers(df: DataFrame, doc: str, depth: int) -> DataFrame:
    """The other columns of `df`, and key (path, like `a[0].b`) and value (double) of every number in its VARIANTs.

    Objects and arrays are opened down to `depth` levels; text that holds a
    number is one.  Keys need not be known before.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c != doc]
    rows = df.select(F.struct(*rest).alias("_rest"), F.lit("").alias("_path"), F.col(doc).alias("_value"))
    for _ in range(depth):
        spread = rows.lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("_value").outer()).alias("f"))
        key = F.when(F.col("_path") == "", F.col("f.key")).otherwise(F.concat("_path", F.lit("."), "f.key"))
        path = F.when(F.col("f.key").isNotNull(), key).otherwise(
            F.concat("_path", F.coalesce(F.concat(F.lit("["), F.col("f.pos").cast("string"), F.lit("]")), F.lit(""))))
        rows = spread.select("_rest", path.alias("_path"), F.coalesce("f.value", "_value").alias("_value"))
    number = F.try_variant_get("_value", "$", "string").try_cast("double")
    return rows.select("_rest.*", F.col("_path").alias("key"), number.alias("value")).where("value is not null")


NOT_JSON = "not a JSON object"


def stage_documents(spark: SparkSession, path: str | list[str], schema: StructType,
                    multi_line: bool = False) -> tuple[DataFrame, DataFrame, str]:
    """Parse landed documents once, into shared scratch: (documents with `_doc_order`, rejected, folder).

    One pass writes good and bad documents, with their verdict.  The rejected
    ones keep reason, file, block and raw text.  The caller deletes the folder.
    """
    text = read_text_documents(spark, path, multi_line)
    parsed = text.withColumn("_doc", parse_json_column("value", schema))
    bad = F.col(f"_doc.{CORRUPT}").isNotNull()
    rows = parsed.select(F.when(bad, "bad").otherwise("good").alias("verdict"), F.when(bad, F.col("value")).alias("raw"),
                         DOC_FILE, DOC_BLOCK, DOC_ORDER,
                         *[F.col(f"_doc.`{n}`").alias(n) for n in schema.fieldNames()])
    folder = shared_folder(spark, "documents")
    rows.write.parquet(folder)
    stored = spark.read.schema(rows.schema).parquet(folder)
    good = stored.where("verdict = 'good'").select(DOC_ORDER, *[F.col(f"`{n}`") for n in schema.fieldNames()])
    rejected = stored.where("verdict = 'bad'").select(F.lit(NOT_JSON).alias("reason"), F.col(DOC_FILE).alias("file"),
                                                      F.col(DOC_BLOCK).alias("block"), "raw")
    return good, rejected, folder


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """Relational source.  Credentials come from the caller's options only.

    For large tables pass `partitionColumn`, `lowerBound`, `upperBound` and
    `numPartitions` so the read is split across tasks.
    """
    return spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options) -> None:
    """Relational sink (one distributed write, batched per partition)."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()
