"""Column helpers that pin the SQL semantics the analytics rely on.

All helpers return native Column expressions: they stay inside whole-stage
codegen, no Python runs per row.
"""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Intermediate scale used before a final 2-place rounding: an exact decimal
# with 6 fractional digits, as the source database keeps for AVG of decimals.
_WORK_DECIMAL = "decimal(18,6)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round2(x, scale: int = 2) -> Column:
    """ROUND(x, 2) with exact decimal, half-up rounding, returned as double.

    Doubles are first pinned to 6 decimal places so that e.g. 1.005 rounds to
    1.01 (decimal semantics) instead of 1.0 (binary float semantics).
    """
    return F.round(_c(x).cast(_WORK_DECIMAL), scale).cast("double")


def round_dec(x, precision: int, scale: int = 2) -> Column:
    """Like `round2` but keeps a DECIMAL(precision, scale) result (for stored columns)."""
    return F.round(_c(x).cast(_WORK_DECIMAL), scale).cast(f"decimal({precision},{scale})")


def avg_int_exact(x) -> Column:
    """AVG of an integer column as an exact DECIMAL with 4 fractional digits.

    The source database returns AVG of exact values as DECIMAL with the
    argument's scale + 4, rounded half up; Spark's AVG of a DECIMAL(p,0)
    follows the same rule.  (AVG of a DECIMAL(p,2) column is already exact
    with 6 places in Spark.)
    """
    return F.avg(_c(x).cast("decimal(20,0)"))


def round_half_up(x, scale: int = 2) -> Column:
    """ROUND of an exact DECIMAL: half away from zero, returned as DOUBLE."""
    return F.round(_c(x), scale).cast("double")


def round_approx(x, scale: int = 2) -> Column:
    """ROUND of a DOUBLE as the source database does it: rint(x * 10^s) / 10^s.

    That is half-to-even on the binary value (8.165 -> 8.16, 12.345 -> 12.34),
    unlike ROUND of an exact decimal.
    """
    p = float(10 ** scale)
    return F.rint(_c(x) * F.lit(p)) / F.lit(p)


def round_float(x, scale: int = 2) -> Column:
    """Python's round(x, scale) of a DOUBLE: half-to-even on the exact binary value.

    `format_number` rounds with java.text.DecimalFormat, which rounds the exact
    binary value half-to-even (2.675 -> 2.67, 12.345 -> 12.35, 3.125 -> 3.12),
    the same result Python's round gives; the text is parsed back to DOUBLE.
    """
    return F.regexp_replace(F.format_number(_c(x), scale), ",", "").cast("double")


def div_decimal(a, b, scale: int) -> Column:
    """a / b for exact values, rounded half up to `scale` places; NULL when b is 0.

    The source database keeps the dividend's scale + 4 places in a division
    (SUM(int) / SUM(DECIMAL(4,1)) has 4, SUM(int) * 100.0 / COUNT(*) has 5).
    """
    return F.try_divide(_c(a), _c(b)).cast(f"decimal(38,{scale})")


def pct2(part, whole) -> Column:
    """ROUND(part * 100.0 / whole, 2): the quotient keeps 5 places, then rounds half up."""
    return round_half_up(div_decimal(_c(part).cast("decimal(20,0)") * F.lit(Decimal("100.0")),
                                     _c(whole).cast("decimal(20,0)"), 5))


def safe_div(a, b) -> Column:
    """a / b with NULL on a zero divisor (source semantics) instead of an error."""
    return F.try_divide(_c(a), _c(b))


def least_strict(*cols) -> Column:
    """LEAST that is NULL when any argument is NULL (Spark's skips NULLs)."""
    cs = [_c(c) for c in cols]
    any_null = cs[0].isNull()
    for c in cs[1:]:
        any_null = any_null | c.isNull()
    return F.when(~any_null, F.least(*cs))


def greatest_strict(*cols) -> Column:
    """GREATEST that is NULL when any argument is NULL."""
    cs = [_c(c) for c in cols]
    any_null = cs[0].isNull()
    for c in cs[1:]:
        any_null = any_null | c.isNull()
    return F.when(~any_null, F.greatest(*cs))


def as_of_date(as_of=None) -> Column:
    """The 'today' of a rolling filter: a literal date, or current_date()."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = _dt.date.fromisoformat(as_of)
    return F.lit(as_of)


def days_back(days: int, as_of=None) -> Column:
    """CURDATE() - INTERVAL n DAY."""
    return F.date_sub(as_of_date(as_of), int(days))


def years_back(years: int, as_of=None) -> Column:
    """DATE_SUB(CURDATE(), INTERVAL n YEAR); 29 Feb clips to 28 Feb."""
    return F.add_months(as_of_date(as_of), -12 * int(years))


def quarter_index(date_col) -> Column:
    """YEAR(d) * 4 + QUARTER(d): consecutive quarters differ by one."""
    d = _c(date_col)
    return F.year(d) * 4 + F.quarter(d)


def month_to_quarter(month_col) -> Column:
    """Calendar month (1-12) to quarter (1-4)."""
    return (F.floor((_c(month_col) - 1) / 3) + 1).cast("int")


def epoch_ms_to_date(x) -> Column:
    """Epoch milliseconds (number or numeric text) to DATE in the session time zone."""
    return F.to_date(F.timestamp_millis(parse_long(x)))


def epoch_ms_to_text(x, fmt: str = "dd MMM yyyy", missing: str = "–") -> Column:
    """Epoch milliseconds to display text; `missing` for absent or bad input."""
    return F.coalesce(F.date_format(F.timestamp_millis(parse_long(x)), fmt), F.lit(missing))


def parse_long(x) -> Column:
    """Integer parse that yields NULL on bad text (ANSI cast would raise)."""
    c = _c(x)
    return F.coalesce(c.try_cast("bigint"), F.floor(c.try_cast("double")).try_cast("bigint"))


def parse_int(x) -> Column:
    """int(text) with thousands separators removed; NULL when not a number.

    Float-looking text is floored first: casting would truncate in one engine
    and round in another (SURVEY 8.12).
    """
    s = F.regexp_replace(_c(x).cast("string"), ",", "")
    return F.coalesce(s.try_cast("int"), F.floor(s.try_cast("double")).try_cast("int"))


def parse_double(x) -> Column:
    """float(text) with thousands separators removed; NULL when not a number."""
    return F.regexp_replace(_c(x).cast("string"), ",", "").try_cast("double")


def parse_decimal(x, precision: int, scale: int) -> Column:
    """DECIMAL parse with thousands separators removed; NULL when not a number."""
    return F.regexp_replace(_c(x).cast("string"), ",", "").try_cast(f"decimal({precision},{scale})")


def unreadable(text, parsed) -> Column:
    """TRUE when a field holds text (not blank) that did not parse."""
    return non_blank(_c(text).cast("string")) & parsed.isNull()


def text_or(x, default: str = "") -> Column:
    """Value of a text field, or `default` when the key is missing / null."""
    return F.coalesce(_c(x).cast("string"), F.lit(default))


def non_blank(x) -> Column:
    """TRUE when the text has a non-space character."""
    return F.coalesce(F.trim(_c(x)) != F.lit(""), F.lit(False))


def hundredths(h, precision: int = 5) -> Column:
    """An integer count of hundredths as DECIMAL(precision, 2), built without division."""
    return (_c(h).cast("decimal(9,2)") * F.lit(0.01).cast("decimal(3,2)")).cast(f"decimal({precision},2)")
