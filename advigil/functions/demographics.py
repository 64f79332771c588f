"""Typed patient fields out of report text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from advigil.fixed_values import (
    AGE_CODE_FACTORS,
    AGE_DIVISORS,
    DAY_PATTERN,
    MAX_PLAUSIBLE_AGE,
)
from advigil.functions.numbers import round_half_even, to_numeric
from advigil.functions.text import strip, trimmed_upper


def _lookup(key: Column, values: dict[str, float]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.try_element_at(table, key)


def parse_event_date(text: Column) -> Column:
    """``YYYYMMDD`` as ``YYYY-MM-DD`` text; anything else is null."""
    t = strip(text)
    day = F.try_to_timestamp(F.when(t.rlike(DAY_PATTERN), t), F.lit("yyyyMMdd"))
    return F.date_format(day, "yyyy-MM-dd")


def parse_age_years(age: Column, unit: Column, dec_years: float = 1.0) -> Column:
    """Age in years from a number and a unit code, two decimals."""
    divisors = {**AGE_DIVISORS, "DEC": 1.0 / dec_years}
    years = to_numeric(age) / _lookup(trimmed_upper(F.coalesce(unit, F.lit(""))), divisors)
    return round_half_even(years, 2)


def normalize_age_ingest(age: Column, code: Column) -> Column:
    """Second policy: numeric unit codes, unknown codes taken as plausible years."""
    raw = to_numeric(age)
    factor = _lookup(strip(F.coalesce(code, F.lit(""))), AGE_CODE_FACTORS)
    converted = raw * factor
    return (
        F.when(
            factor.isNull(),
            F.when((raw > 0) & (raw <= MAX_PLAUSIBLE_AGE), round_half_even(raw, 2)),
        )
        .when((converted >= 0) & (converted <= MAX_PLAUSIBLE_AGE), round_half_even(converted, 2))
    )


def parse_sex(sex: Column) -> Column:
    s = trimmed_upper(sex)
    return F.when(s.isin("F", "M"), s)


def parse_sex_ingest(sex: Column) -> Column:
    s = trimmed_upper(sex)
    return F.when(s.isin("1", "M", "MALE"), "M").when(s.isin("2", "F", "FEMALE"), "F")
