"""Candidate signals out of the statistics table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advigil.functions.identifiers import signal_id
from advigil.policy import DETECTION, DetectionPolicy
from advigil.schemas import SIGNAL


def above_thresholds(policy: DetectionPolicy = DETECTION) -> Column:
    """Null statistics fail the comparison, so they never pass."""
    return (
        (F.col("a") >= policy.min_reports)
        & (F.col("prr") >= policy.min_prr)
        & (F.col("chi_square") >= policy.min_chi_square)
    )


def detect_signals(
    metrics: DataFrame, release: str | Column | None, policy: DetectionPolicy = DETECTION
) -> DataFrame:
    """Pairs above all thresholds in the shape of the signal contract."""
    release = release if isinstance(release, Column) else F.lit(release).cast("string")
    return metrics.filter(above_thresholds(policy)).select(
        signal_id(F.col("drug_name"), F.col("event_name")).alias("signal_id"),
        "drug_name",
        "event_name",
        F.col("a").alias("supporting_report_count"),
        "prr",
        "ror",
        F.lit(None).cast("double").alias("trend_score"),
        F.lit(None).cast("double").alias("risk_score"),
        F.lit(None).cast("string").alias("priority_level"),
        F.lit("candidate").alias("candidate_status"),
        release.alias("dataset_version"),
    )


def in_detection_order(signals: DataFrame) -> DataFrame:
    """Most reports first, then strongest PRR, then names."""
    return signals.orderBy(
        F.desc("supporting_report_count"), F.desc("prr"), "drug_name", "event_name"
    )


def candidate_signals_export(signals: DataFrame) -> DataFrame:
    """The contract columns; scores are not part of a fresh export."""
    empty = {"trend_score", "risk_score", "priority_level"}
    return signals.select(
        *[
            (F.lit(None) if f.name in empty else F.col(f.name)).cast(f.dataType).alias(f.name)
            for f in SIGNAL.fields
        ]
    )


def detection_stats(metrics: DataFrame, policy: DetectionPolicy = DETECTION) -> DataFrame:
    """Evaluated, above-threshold and defined-statistic counts; one row."""
    above = F.count_if(above_thresholds(policy))
    return metrics.agg(
        F.count(F.lit(1)).alias("total_pairs_evaluated"),
        above.alias("pairs_above_thresholds"),
        F.count("prr").alias("finite_prr_pairs"),
        F.count("chi_square").alias("finite_chi2_pairs"),
        F.count("ror").alias("finite_ror_pairs"),
        above.alias("candidates_detected"),
    )
