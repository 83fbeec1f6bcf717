"""Named queries bound to the test tables, with their oracle SQL.

`registered_queries()` maps a name to `fn(spark, sf_dir) -> DataFrame`; every
entry reads the test tables of `sf_dir` (through the derived tables), so its
work grows with the data.  `oracle_queries()` holds the matching SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DecimalType, FloatType, IntegerType, ShortType

from crease.plans import analytics as A
from crease.plans.oracle_sql import ORACLE_QUERIES, with_tables
from crease.sources.fixtures import fixture_tables

# Parameters that differ from the source's constants on the test tables
# (FIXTURES.md "Query parameters on fixtures").
AS_OF = "2001-08-01"
FIXTURE_PARAMS: dict[str, dict] = {
    "q01_players_by_country": dict(country="NATION_7"),
    "q02_recent_matches": dict(as_of=AS_OF),
    "q09_allrounders": dict(role="FURNITURE"),
    "q16_yearly_batting": dict(since="1996-01-01"),
    "q19_consistent_batsmen": dict(since="1996-01-01"),
    "q22a_head_to_head": dict(as_of=AS_OF),
    "q22b_head_to_head_ordered": dict(as_of=AS_OF),
}


def normalize_types(df: DataFrame) -> DataFrame:
    """Integers -> BIGINT, decimals / floats -> DOUBLE, for engine-neutral comparison."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (IntegerType, ShortType, ByteType)):
            cols.append(F.col(f"`{f.name}`").cast("bigint").alias(f.name))
        elif isinstance(f.dataType, (DecimalType, FloatType)):
            cols.append(F.col(f"`{f.name}`").cast("double").alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def _bind(fn, params) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return normalize_types(fn(fixture_tables(spark, sf_dir), **params))
    run.__name__ = fn.__name__
    return run


def analytic_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bind(fn, FIXTURE_PARAMS.get(name, {})) for name, fn in A.ALL_QUERIES.items()}


def analytic_oracles() -> dict[str, str]:
    return {name: with_tables(sql) for name, sql in ORACLE_QUERIES.items()}
