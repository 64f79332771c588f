"""Numeric conversion and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from advigil.fixed_values import NUMBER_PATTERN
from advigil.functions.text import strip


def finite(x: Column) -> Column:
    """NaN and both infinities become null."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def finite_non_negative(x: Column) -> Column:
    """``finite`` that also turns negative numbers into null."""
    x = finite(x)
    return F.when(x >= 0, x)


def safe_int(x: Column) -> Column:
    """Whole part of a finite number, else null."""
    return finite(x).try_cast("bigint")


def to_numeric(text: Column) -> Column:
    """Trimmed decimal text as double; blank or unparseable text is null."""
    t = strip(text)
    return finite(F.when(t.rlike(NUMBER_PATTERN), t.try_cast("double")))


def round_half_even(x: Column, digits: int) -> Column:
    """Scaled rounding with ties to even."""
    scale = float(10**digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def fixed_decimals(x: Column, digits: int = 2) -> Column:
    """Text with a fixed number of decimals and no grouping."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def short_number(x: Column) -> Column:
    """Shortest text of a number: a whole double prints without ``.0``."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def page_count(total: Column, page_size: int) -> Column:
    """Number of pages, at least one."""
    return F.greatest(F.ceil(total / F.lit(page_size)), F.lit(1)).cast("bigint")
