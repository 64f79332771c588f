"""Risk score, priority level and reporting trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from advigil.fixed_values import QUARTER_PATTERN
from advigil.functions.numbers import finite, finite_non_negative, round_half_even
from advigil.policy import RISK, RiskPolicy


def _share_of_cap(x: Column, cap: float) -> Column:
    """Share of the cap, 0 for a missing value (``least`` alone would skip the null)."""
    return F.when(x.isNotNull(), F.least(x, F.lit(cap)) / F.lit(cap)).otherwise(F.lit(0.0))


def _ratio_part(ratio: Column, lower: Column, cap: float) -> Column:
    """Lower bound when present, else the ratio; below 1 counts as 0."""
    value = finite_non_negative(F.when(lower.isNotNull(), lower).otherwise(ratio))
    return _share_of_cap(F.when(value < 1, F.lit(0.0)).otherwise(value), cap)


def risk_score(
    prr: Column,
    ror: Column,
    count: Column,
    chi_square: Column,
    prr_lower: Column,
    ror_lower: Column,
    policy: RiskPolicy = RISK,
) -> Column:
    """Weighted score in [0, 1]; null without a valid ratio or without reports."""
    n = finite_non_negative(count)
    enough = n >= policy.min_reports
    volume = F.when(enough, _share_of_cap(F.log1p(n), policy.log_count_cap)).otherwise(F.lit(0.0))
    score = (
        F.lit(policy.prr_weight) * _ratio_part(prr, prr_lower, policy.prr_cap)
        + F.lit(policy.volume_weight) * volume
        + F.lit(policy.chi_square_weight)
        * _share_of_cap(finite_non_negative(chi_square), policy.chi_square_cap)
        + F.lit(policy.ror_weight) * _ratio_part(ror, ror_lower, policy.ror_cap)
    )
    usable = finite_non_negative(prr).isNotNull() | finite_non_negative(ror).isNotNull()
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return F.when(usable & enough, round_half_even(clamped, 6))


def priority_level(risk: Column, policy: RiskPolicy = RISK) -> Column:
    r = finite(risk)
    return (
        F.when(r >= policy.critical, "critical")
        .when(r >= policy.high, "high")
        .when(r >= policy.medium, "medium")
        .when(r.isNotNull(), "low")
    )


def parse_trend_data(text: Column) -> Column:
    """JSON list of points as an array; text that is no such list is null."""
    return F.when(
        F.trim(text).startswith("["), F.from_json(text, "array<struct<quarter:string,count:string>>")
    )


def trend_score(points: Column) -> Column:
    """Slope of the counts over their order, relative to their mean, in [-1, 1].

    ``points`` is an array of (quarter, count). Null for fewer than two points,
    for any invalid point, or for a mean that is not positive. The array holds
    one element per quarter, so it stays small for any number of reports.
    """
    valued = F.transform(
        points,
        lambda p, i: F.struct(
            p["quarter"].alias("quarter"),
            i.alias("i"),
            finite_non_negative(p["count"].try_cast("double")).alias("y"),
        ),
    )
    broken = F.exists(valued, lambda p: p["quarter"].isNull() | p["y"].isNull())
    ordered = F.array_sort(valued)
    n = F.size(points).cast("double")
    total = F.aggregate(ordered, F.lit(0.0), lambda acc, p: acc + p["y"])
    weighted = F.aggregate(
        F.transform(ordered, lambda p, i: (i.cast("double") - (n - 1) / F.lit(2.0)) * p["y"]),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )
    slope = F.try_divide(F.lit(12.0) * weighted, n * (n * n - 1))
    relative = F.try_divide(slope, total / n)
    clamped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), relative))
    usable = (F.size(points) >= 2) & ~broken & (total > 0)
    return F.when(usable, round_half_even(clamped, 6))


def trend_scores_by_key(points: DataFrame, key: str, period: str, count: str) -> DataFrame:
    """(key, trend_score) of one row per key and period, as ``trend_score`` of its series.

    Periods are numbered within their key and summed up: no series is collected, however long.
    """
    order = W.partitionBy(key).orderBy(period)
    y, x = F.col(count).cast("double"), (F.row_number().over(order) - 1).cast("double")
    numbered = points.select(key, F.when(F.col(period).isNotNull(), finite_non_negative(y)).alias("y"), x.alias("x"))
    sums = numbered.groupBy(key).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.count("y").alias("good"), F.sum("y").alias("total"), F.sum(F.col("x") * F.col("y")).alias("product")
    )
    n, total = F.col("n"), F.col("total")
    weighted = F.col("product") - (n - 1) / F.lit(2.0) * total
    relative = F.try_divide(F.try_divide(F.lit(12.0) * weighted, n * (n * n - 1)), total / n)
    usable = (n >= 2) & (F.col("good") == n) & (total > 0)
    clamped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), relative))
    return sums.select(key, F.when(usable, round_half_even(clamped, 6)).alias("trend_score"))


def clean_trend_points(points: Column) -> Column:
    """Valid points only, first of each quarter, in quarter order, with bar width.

    Works on one signal's array of points (one per quarter).
    """
    numbered = F.transform(
        points,
        lambda p, i: F.struct(
            F.trim(p["quarter"]).alias("quarter"),
            i.alias("i"),
            finite_non_negative(p["count"].try_cast("double")).alias("count"),
        ),
    )
    valid = F.filter(
        numbered, lambda p: p["quarter"].rlike(QUARTER_PATTERN) & p["count"].isNotNull()
    )
    ordered = F.array_sort(valid)
    first = F.filter(
        ordered,
        lambda p, i: (i == 0) | (F.get(ordered, i - 1)["quarter"] != p["quarter"]),
    )
    peak = F.array_max(F.transform(first, lambda p: p["count"]))
    return F.transform(
        first,
        lambda p: F.struct(
            p["quarter"].alias("quarter"),
            p["count"].alias("count"),
            F.coalesce(F.try_divide(p["count"], peak), F.lit(0.0)).alias("width"),
        ),
    )
