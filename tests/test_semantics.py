"""Hand cases for the SQL-semantics helpers."""

import datetime as dt

from pyspark.sql import functions as F

from crease.functions import semantics as S


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_round2_is_decimal_half_up(spark):
    assert one(spark, S.round2(F.lit(1.005))) == 1.01
    assert one(spark, S.round2(F.lit(2.675))) == 2.68
    assert one(spark, S.round2(F.lit(-1.005))) == -1.01


def test_pct2_and_safe_div(spark):
    assert one(spark, S.pct2(F.lit(1), F.lit(3))) == 33.33
    assert one(spark, S.pct2(F.lit(1), F.lit(0))) is None
    assert one(spark, S.safe_div(F.lit(1), F.lit(0))) is None


def test_least_greatest_are_null_strict(spark):
    assert one(spark, S.least_strict(F.lit(1), F.lit(None).cast("int"))) is None
    assert one(spark, S.greatest_strict(F.lit(None).cast("int"), F.lit(3))) is None
    assert one(spark, S.least_strict(F.lit(4), F.lit(3))) == 3


def test_parsers(spark):
    assert one(spark, S.parse_int(F.lit("1,234"))) == 1234
    assert one(spark, S.parse_int(F.lit("abc"))) is None
    assert one(spark, S.parse_int(F.lit("12.7"))) == 12
    assert one(spark, S.parse_int(F.lit(""))) is None
    assert one(spark, S.parse_double(F.lit("1,234.5"))) == 1234.5
    assert str(one(spark, S.parse_decimal(F.lit("4.25"), 4, 2))) == "4.25"


def test_dates(spark):
    ms = 1_700_000_000_000  # 2023-11-14 22:13:20 UTC
    assert one(spark, S.epoch_ms_to_date(F.lit(str(ms)))) == dt.date(2023, 11, 14)
    assert one(spark, S.epoch_ms_to_text(F.lit(str(ms)))) == "14 Nov 2023"
    assert one(spark, S.epoch_ms_to_text(F.lit("oops"))) == "–"
    assert one(spark, S.years_back(3, "2024-02-29")) == dt.date(2021, 2, 28)
    assert one(spark, S.days_back(30, "2001-08-01")) == dt.date(2001, 7, 2)
    assert [one(spark, S.month_to_quarter(F.lit(m))) for m in (1, 3, 4, 12)] == [1, 1, 2, 4]


def test_non_blank(spark):
    assert one(spark, S.non_blank(F.lit("  "))) is False
    assert one(spark, S.non_blank(F.lit(None).cast("string"))) is False
    assert one(spark, S.non_blank(F.lit("not out"))) is True


def test_source_exact_value_rules(spark):
    # ROUND of a DOUBLE: rint on the binary value
    assert one(spark, S.round_approx(F.lit(8.165))) == 8.16      # 816.4999... -> 816
    assert one(spark, S.round_approx(F.lit(12.345))) == 12.34    # 1234.5 exactly -> even
    assert one(spark, S.round_approx(F.lit(2.675))) == 2.68      # 267.5 exactly -> even
    # a division keeps the dividend's scale + 4 places before ROUND(., 2):
    # 24699 / 20000.0 = 1.23495 -> 1.2350 -> 1.24 (the 6-place route would give 1.23)
    q = S.div_decimal(F.lit(24699).cast("decimal(20,0)"), F.lit("20000.0").cast("decimal(14,1)"), 4)
    assert one(spark, S.round_half_up(q)) == 1.24
    # AVG of integers is an exact 4-place decimal
    df = spark.createDataFrame([(1,), (2,), (2,)], "x int")
    assert str(df.select(S.avg_int_exact("x").alias("v")).first().v) == "1.6667"
