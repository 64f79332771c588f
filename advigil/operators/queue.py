"""The review queue: filters, order, pages and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advigil.functions.numbers import page_count
from advigil.functions.scores import trend_score
from advigil.operators.support import trend_series

QUEUE_COLUMNS = (
    "signal_id", "drug_name", "event_name", "supporting_report_count", "prr", "ror",
    "trend_score", "risk_score", "priority_level", "candidate_status", "dataset_version", "rank",
)


def queue_filters(
    signals: DataFrame,
    drug: str | None = None,
    event: str | None = None,
    min_prr: float | None = None,
    status: str | None = None,
    release: str | None = None,
) -> DataFrame:
    out = signals
    if drug:
        out = out.filter(F.upper("drug_name").contains(drug.strip().upper()))
    if event:
        out = out.filter(F.upper("event_name").contains(event.strip().upper()))
    if min_prr is not None:
        out = out.filter(F.col("prr") >= min_prr)
    if status:
        out = out.filter(F.col("candidate_status") == status)
    if release:
        out = out.filter(F.col("dataset_version") == release)
    return out


def queue_search(
    signals: DataFrame, text: str = "", priority: str = "all", status: str = "all"
) -> DataFrame:
    """Text in drug or event, plus exact priority and status."""
    wanted = text.strip().lower()
    out = signals
    if wanted:
        out = out.filter(
            F.lower("drug_name").contains(wanted) | F.lower("event_name").contains(wanted)
        )
    if priority != "all":
        out = out.filter(F.col("priority_level") == priority)
    if status != "all":
        out = out.filter(F.col("candidate_status") == status)
    return out


def queue_order(signals: DataFrame, sort_by: str = "rank", descending: bool = False) -> list:
    """Order by a queue column (an unknown one means rank), nulls last, then id."""
    column = sort_by if sort_by in signals.columns else "rank"
    first = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    return [first, F.asc("signal_id")]


def queue_page(
    signals: DataFrame,
    sort_by: str = "rank",
    descending: bool = False,
    page: int = 1,
    page_size: int = 20,
) -> DataFrame:
    """One page. Spark takes the top rows per partition, it does not sort the table."""
    return (
        signals.orderBy(*queue_order(signals, sort_by, descending))
        .offset(max(0, (page - 1) * page_size))
        .limit(page_size)
    )


def queue_total(signals: DataFrame, page_size: int = 20) -> DataFrame:
    """Matching signals, pages and signals still open; one row."""
    total = F.count(F.lit(1))
    return signals.agg(
        total.alias("total"),
        page_count(total, page_size).alias("pages"),
        F.count_if(F.col("candidate_status") != "closed").alias("open_signals"),
    )


def queue_with_metrics(
    signals: DataFrame, metrics: DataFrame, reports: DataFrame, scope: str = "release"
) -> DataFrame:
    """Queue rows with the trend score recomputed from stored or computed series.

    The fallback series is computed only for signals without a stored one.
    """
    stored = metrics.select("signal_id", F.col("trend_data").alias("_stored")).filter(
        F.col("_stored").isNotNull()
    )
    open_signals = signals.join(stored.select("signal_id"), "signal_id", "left_anti")
    series = stored.withColumnRenamed("_stored", "_series").unionByName(
        trend_series(open_signals, reports, scope).withColumnRenamed("trend_data", "_series")
    )
    rows = signals.join(series, "signal_id", "left").withColumn(
        "trend_score", trend_score(F.col("_series"))
    )
    return rows.select(*[c for c in QUEUE_COLUMNS if c in rows.columns])
