"""Table scans, table creation and the stored-table mapping.

Analytics take a *tables* mapping: name -> DataFrame.  `TableSet` is a lazy
mapping: a table's plan is only built when a query asks for it, so every
query scans just the tables (and, via Catalyst pruning, columns) it needs.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.sources.schemas import TABLE_DDL, table_schema


class TableSet(Mapping):
    """Lazy name -> DataFrame mapping; each builder runs at most once."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]):
        self._builders = dict(builders)
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name not in self._builders:
                raise KeyError(name)
            self._cache[name] = self._builders[name]()
        return self._cache[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, through the cluster's file system; any other trouble raises."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def table_path(base_dir: str, name: str) -> str:
    """Parquet location of a table: a directory `<base>/<name>` or a file `<base>/<name>.parquet`."""
    single = os.path.join(base_dir, f"{name}.parquet")
    if base_dir.startswith(("/", "file:")) and os.path.exists(single.replace("file:", "")):
        return single
    return os.path.join(base_dir, name)


def load_table(spark: SparkSession, base_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Scan one stored table with its declared schema (no inference).

    Folder columns of the layout that the table does not declare are left out.
    """
    reader = spark.read
    if name in TABLE_DDL:
        schema = table_schema(name)
        reader, columns = reader.schema(schema), columns or schema.fieldNames()
    df = reader.parquet(table_path(base_dir, name))
    return df.select(*columns) if columns else df


def load_tables(spark: SparkSession, base_dir: str, names: list[str] | None = None) -> TableSet:
    """A lazy TableSet over stored target tables."""
    names = names or list(TABLE_DDL)
    return TableSet({n: (lambda n=n: load_table(spark, base_dir, n)) for n in names})


def create_tables(spark: SparkSession, base_dir: str, names: list[str] | None = None,
                  mode: str = "ignore") -> list[str]:
    """Create empty Parquet tables with the declared schemas.

    `mode="ignore"` leaves existing tables untouched (CREATE TABLE IF NOT EXISTS).
    """
    created = []
    for name in names or list(TABLE_DDL):
        empty = spark.createDataFrame([], table_schema(name))
        empty.write.mode(mode).parquet(os.path.join(base_dir, name))
        created.append(name)
    return created


def write_tables(tables: Mapping[str, DataFrame], base_dir: str, names: list[str] | None = None,
                 mode: str = "overwrite", parallel: int = 1) -> None:
    """Store a TableSet as Parquet (one folder per table).

    `parallel > 1` submits the independent writes from that many driver
    threads; Spark runs jobs from different threads concurrently, so small
    tables no longer wait on each other's scheduling.  Plans are built first,
    one at a time, so lazily built tables are never built twice.
    """
    names = names or list(tables)
    plans = [(n, tables[n]) for n in names]

    def write(item):
        name, df = item
        df.write.mode(mode).parquet(os.path.join(base_dir, name))

    if parallel <= 1:
        for item in plans:
            write(item)
        return
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        for f in [pool.submit(write, item) for item in plans]:
            f.result()


# Partition layout: filters on these columns prune whole folders.  Dates are
# the columns the questions filter by range (Q2, Q16, Q19, Q22), format the
# one they filter by value (Q3, Q18, Q20).
PARTITIONING: dict[str, list[str]] = {
    "matches": ["match_date"],
    "player_recent_form": ["match_date"],
    "batting_stats": ["format"],
    "bowling_stats": ["format"],
    "player_format_summary": ["format"],
}


def write_partitioned_tables(tables: Mapping[str, DataFrame], base_dir: str, names: list[str] | None = None,
                             mode: str = "overwrite") -> None:
    """Store tables as Parquet, partitioning those in PARTITIONING by folder.

    A rebalance hint clusters the rows by the partition columns, so that a
    write task produces few files, and splits large values over several tasks
    (a format may hold a third of a fact table).  `load_table` reads them back
    with the declared schema, partition columns included.
    """
    for name in names or list(tables):
        df = tables[name]
        w = df.write.mode(mode)
        if name in PARTITIONING:
            cols = PARTITIONING[name]
            w = df.hint("rebalance", *[F.col(c) for c in cols]).write.mode(mode).partitionBy(*cols)
        w.parquet(os.path.join(base_dir, name))


# Storage layout for co-located joins at scale: every table that joins on
# match_id is bucketed by it with one shared bucket count, so a sort-merge
# join between two of them reads matching buckets and shuffles neither side.
CO_LOCATION: dict[str, list[str]] = {
    "matches": ["match_id"],
    "batting_stats": ["match_id"],
    "bowling_stats": ["match_id"],
    "player_recent_form": ["match_id"],
    "fielding_stats": ["match_id"],
    "batting_partnerships": ["match_id"],
}


def write_bucketed_tables(spark: SparkSession, tables: Mapping[str, DataFrame], base_dir: str,
                          num_buckets: int, names: list[str] | None = None,
                          prefix: str = "crease_") -> TableSet:
    """Store tables as catalog tables, bucketing the match-keyed ones (CO_LOCATION).

    Rows are hash-partitioned on the bucket column first, so each write task
    produces one file per bucket instead of one per (task, bucket).  Returns a
    TableSet reading the catalog tables, which carry the bucket spec the
    planner needs to skip the shuffle.
    """
    names = names or list(tables)
    for name in names:
        df = tables[name]
        w = None
        if name in CO_LOCATION:
            cols = CO_LOCATION[name]
            w = (df.repartition(num_buckets, *cols).write.bucketBy(num_buckets, *cols).sortBy(*cols))
        else:
            w = df.write
        (w.mode("overwrite").format("parquet").option("path", os.path.join(base_dir, name))
         .saveAsTable(prefix + name))
    return TableSet({n: (lambda n=n: spark.table(prefix + n)) for n in names})


def _below(ends: Column, x: Column) -> Column:
    return F.size(F.filter(ends, lambda end: end < x))


def curve_position(df: DataFrame, columns: Sequence[str], bits: int = 6) -> Column:
    """Place of a row on a space-filling curve over the columns' quantiles: their bits interleaved.

    Each column (date or number) is cut at 2^bits - 1 approximate quantiles of
    `df`, so equal stretches of the curve hold about equal numbers of rows
    whatever the distribution; only the cuts come to the driver.  NULLs come first.
    """
    kinds = dict(df.dtypes)
    number = {c: F.unix_date(c) if kinds[c] == "date" else F.col(c).cast("double") for c in columns}
    shares = [k / 2 ** bits for k in range(1, 2 ** bits)]
    cuts = df.agg(*[F.percentile_approx(number[c], shares, 10_000).alias(c) for c in columns]).first()
    place = F.lit(0).cast("bigint")
    for j, c in enumerate(columns):
        ends = F.array(*[F.lit(x) for x in cuts[c] or [0]])
        slot = F.when(number[c].isNull(), 0).otherwise(_below(ends, number[c]))
        for k in range(bits):
            bit = F.shiftright(slot, k).bitwiseAND(F.lit(1)).cast("bigint")
            place = place + F.shiftleft(bit, k * len(columns) + j)
    return place


def write_clustered(df: DataFrame, path: str, columns: Sequence[str], files: int | None = None, bits: int = 6) -> None:
    """Store rows along :func:`curve_position`, so that range filters on any of the columns skip files and row groups.

    Sorting by one column lets only its filters skip; along the curve every
    file holds a small box of all columns' ranges.
    """
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = df.withColumn("_place", curve_position(df, columns, bits))
    placed.repartitionByRange(n, "_place", *columns).sortWithinPartitions("_place", *columns).drop("_place") \
        .write.parquet(path)


#: the columns that the questions filter by range, per table (Q16, Q19)
CLUSTERING: dict[str, list[str]] = {"player_recent_form": ["match_date", "player_id"],
                                    "player_match": ["match_date", "player_id"]}
