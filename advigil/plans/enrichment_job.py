"""Batch job: candidate signals plus metrics to scored, ranked signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from advigil.operators.enrichment import enrich_signals, enrichment_summary, rank_signals
from advigil.policy import RISK, RiskPolicy
from advigil.sinks.files import write_records_json
from advigil.sinks.records import SIGNAL_CONTRACT, validate_records
from advigil.sources.signals import scan_metrics_csv, scan_signals_json


def run_enrichment(
    spark: SparkSession,
    signals_path: str,
    metrics_path: str | None,
    output: str,
    policy: RiskPolicy = RISK,
) -> DataFrame:
    """Write the enriched signals and return their summary."""
    signals = scan_signals_json(spark, signals_path)
    ranked = rank_signals(enrich_signals(signals, scan_metrics_csv(spark, metrics_path), policy))
    write_records_json(validate_records(ranked, SIGNAL_CONTRACT, "signals", ignore=("rank",)), output)
    return enrichment_summary(ranked)
