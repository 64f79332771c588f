"""Scores, ranks and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advigil.functions.numbers import finite
from advigil.functions.scores import priority_level, risk_score, trend_score
from advigil.operators.ordering import numbered_by_group
from advigil.policy import RISK, RiskPolicy


def enrich_signals(
    signals: DataFrame, metrics: DataFrame, policy: RiskPolicy = RISK
) -> DataFrame:
    """Signals with risk score, priority and trend; other fields stay as they are.

    ``metrics`` has signal_id, chi_square, prr_lower, ror_lower and optionally
    trend_data as an array of (quarter, count).
    """
    has_trend = "trend_data" in metrics.columns
    wanted = ["signal_id", "chi_square", "prr_lower", "ror_lower"] + ["trend_data"] * has_trend
    m = metrics.select(
        "signal_id", *[F.col(c).alias(f"_{c}") for c in wanted if c != "signal_id"]
    )
    risk = risk_score(
        finite(F.col("prr")),
        finite(F.col("ror")),
        F.col("supporting_report_count"),
        finite(F.col("_chi_square")),
        finite(F.col("_prr_lower")),
        finite(F.col("_ror_lower")),
        policy,
    )
    trend = trend_score(F.col("_trend_data")) if has_trend else F.lit(None).cast("double")
    scored = signals.join(m, "signal_id", "left").withColumns(
        {"risk_score": risk, "trend_score": trend}
    )
    return scored.withColumn("priority_level", priority_level(F.col("risk_score"), policy)).select(
        *signals.columns
    )


def rank_signals(signals: DataFrame) -> DataFrame:
    """Rank within each dataset version: risk, trend, reports, names, id."""
    order = [
        F.desc_nulls_last("risk_score"),
        F.desc_nulls_last("trend_score"),
        F.coalesce("supporting_report_count", F.lit(0)).desc(),
        F.upper(F.coalesce("drug_name", F.lit(""))).asc(),
        F.upper(F.coalesce("event_name", F.lit(""))).asc(),
        F.asc("signal_id"),
    ]
    columns = [c for c in signals.columns if c != "rank"]
    ranked = numbered_by_group(signals.select(*columns), "dataset_version", order, "rank")
    return ranked.withColumn("rank", F.col("rank").cast("int"))


def enrichment_summary(signals: DataFrame) -> DataFrame:
    """Totals and signals per priority, as one row."""
    levels = {
        f"priority_{level or 'none'}": (
            F.count_if(F.col("priority_level") == level)
            if level
            else F.count_if(F.col("priority_level").isNull())
        )
        for level in ("critical", "high", "medium", "low", None)
    }
    return signals.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("risk_score").alias("with_risk_score"),
        F.count("trend_score").alias("with_trend_score"),
        *[column.alias(name) for name, column in levels.items()],
    )
