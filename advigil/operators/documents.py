"""Documents of signals and their latest analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advigil import fixed_values as V
from advigil.functions.identifiers import facts_hash


def latest_per_key(rows: DataFrame, key: str, time: str = "created_at") -> DataFrame:
    """Newest row of every key: a grouped maximum, combined on the map side."""
    others = [c for c in rows.columns if c not in (key, time)]
    newest = F.max(F.struct(time, *others)).alias("_newest")
    return (
        rows.groupBy(key)
        .agg(newest)
        .select(*[F.col(c) if c == key else F.col(f"_newest.{c}").alias(c) for c in rows.columns])
    )


def documents_latest_analysis(documents: DataFrame, analyses: DataFrame) -> DataFrame:
    """Documents with their latest analysis, if any."""
    latest = latest_per_key(
        analyses.select(
            "document_id",
            "created_at",
            "analysis_id",
            "analysis_status",
            "potential_coverage_gap",
            "relevant_sections",
            "human_review_required",
        ),
        "document_id",
    ).drop("created_at")
    joined = documents.join(latest, "document_id", "left")
    return joined.select(
        "signal_id",
        "document_id",
        "filename",
        "analysis_id",
        "analysis_status",
        F.coalesce(F.size("relevant_sections"), F.lit(0)).alias("relevant_section_count"),
        "potential_coverage_gap",
        F.coalesce("human_review_required", F.lit(True)).alias("human_review_required"),
    )


def unknown_signal_documents(documents: DataFrame, signals: DataFrame) -> DataFrame:
    """Documents that name a signal which does not exist; none if there are no signals."""
    known = signals.agg(F.count(F.lit(1)).alias("n"))
    return (
        documents.filter(F.coalesce("signal_id", F.lit("")) != "")
        .join(signals.select("signal_id"), "signal_id", "left_anti")
        .filter(known.scalar() > 0)
    )


def document_context(documents: DataFrame, signals: DataFrame) -> DataFrame:
    """Signal facts for each document; an unknown signal leaves only its id."""
    facts = signals.select(
        "signal_id",
        "drug_name",
        "event_name",
        F.col("supporting_report_count").alias("report_count"),
        "prr",
        "priority_level",
        F.array(*[F.lit(x) for x in V.CONTEXT_REVIEW_AREAS]).alias("review_areas"),
    )
    return documents.select("document_id", F.nullif("signal_id", F.lit("")).alias("signal_id")).join(
        facts, "signal_id", "left"
    )


def document_prompt_hash(documents: DataFrame, signals: DataFrame) -> DataFrame:
    """Hash over id, whole text and signal facts of each document."""
    context = document_context(documents, signals)
    signal = F.struct(
        "drug_name", "event_name", "priority_level", "prr", "report_count", "review_areas", "signal_id"
    )
    facts = F.struct(
        F.col("document_id").alias("doc_id"),
        F.when(F.col("signal_id").isNotNull(), signal).alias("signal"),
        F.col("extracted_text").alias("text"),
    )
    texts = documents.select("document_id", "extracted_text")
    return context.join(texts, "document_id").select(
        "document_id", facts_hash(facts).alias("prompt_hash")
    )
