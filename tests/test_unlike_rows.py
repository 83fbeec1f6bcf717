"""Rows that differ from the stored ones, by part."""

from crease.operators.keys import other_rows
from crease.operators.upsert import _unlike


def test_rows_unlike_the_stored_ones_take_one_exchange_by_part(spark):
    schema = "k bigint, g string, v decimal(5,2), key_part_4 int"
    stored = spark.createDataFrame([(1, "a", None, 0), (2, None, None, 1), (3, "c", None, 1), (4, "d", None, 2)], schema)
    given = spark.createDataFrame([(1, "a", None, 0), (2, None, None, 1), (3, None, None, 1), (5, "e", None, 2), (None, None, None, 3)],
                                  schema)
    got = _unlike(given, stored, "key_part_4")
    want = sorted(map(str, other_rows(given, stored, given.columns, null_safe=True).collect()))
    assert got.columns == given.columns and sorted(map(str, got.collect())) == want and len(want) == 3
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    exchanges = got.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges == 1 and "Join" not in plan
