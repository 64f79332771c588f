"""Pair counts, margins, 2x2 tables and disproportionality statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advigil.functions import disproportionality as stat
from advigil.functions.identifiers import signal_id
from advigil.policy import DETECTION, DetectionPolicy
from advigil.functions.text import strip


def pair_counts(pairs: DataFrame, *by: str) -> DataFrame:
    """Reports per (drug, event) and any further grouping columns."""
    return pairs.groupBy("drug_name", "event_name", *by).agg(F.count(F.lit(1)).alias("a"))


def quarterly_pair_counts(pairs: DataFrame, quarter: str = "report_quarter") -> DataFrame:
    """Pairs per (drug, event, quarter); rows with a blank name are skipped."""
    named = pairs.select(
        strip("drug_name").alias("drug_name"),
        strip("event_name").alias("event_name"),
        F.col(quarter).alias("quarter"),
    ).filter("drug_name <> '' and event_name <> ''")
    return named.groupBy("drug_name", "event_name", "quarter").agg(F.count(F.lit(1)).alias("count"))


def margins(counts: DataFrame) -> DataFrame:
    """Pair counts with the drug margin, the event margin and the grand total.

    Margins are grouped sums joined back, not windows: a drug or event with a large
    share of all pairs is summed on the map side first, and the joined side has one
    row per name, so Spark broadcasts it when its measured size allows and otherwise
    splits the hot key. ``counts`` is read four times and should be a stored table.
    """
    drug = counts.groupBy("drug_name").agg(F.sum("a").alias("n_drug"))
    event = counts.groupBy("event_name").agg(F.sum("a").alias("n_event"))
    total = counts.agg(F.sum("a").alias("n_total"))
    return (
        counts.join(drug, "drug_name")
        .join(event, "event_name")
        .withColumn("n_total", total.scalar())
    )


def contingency(counts: DataFrame) -> DataFrame:
    """The four cells of every pair; further columns of the counts are kept."""
    a, n_drug, n_event = F.col("a"), F.col("n_drug"), F.col("n_event")
    return margins(counts).withColumns(
        {
            "b": n_drug - a,
            "c": n_event - a,
            "d": F.col("n_total") - n_drug - n_event + a,
        }
    )


def with_statistics(cells: DataFrame, policy: DetectionPolicy = DETECTION) -> DataFrame:
    """PRR, ROR, their intervals and chi-square for rows with cells a, b, c, d."""
    t = stat.Cells.of(policy)
    prr_low, prr_high = stat.prr_interval(t, policy.z)
    ror_low, ror_high = stat.ror_interval(t, policy.z)
    return cells.select(
        "*",
        stat.prr(t).alias("prr"),
        prr_low.alias("prr_lower"),
        prr_high.alias("prr_upper"),
        stat.chi_square(t, policy.yates).alias("chi_square"),
        stat.ror(t).alias("ror"),
        ror_low.alias("ror_lower"),
        ror_high.alias("ror_upper"),
    )


def disproportionality(counts: DataFrame, policy: DetectionPolicy = DETECTION) -> DataFrame:
    """Signal id, cells and statistics of every row of stored ``pair_counts``."""
    stats = with_statistics(contingency(counts), policy)
    return stats.withColumn("signal_id", signal_id(F.col("drug_name"), F.col("event_name")))
