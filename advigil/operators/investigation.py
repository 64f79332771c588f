"""Everything known about a signal in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advigil.functions import texts
from advigil.functions.identifiers import facts_hash
from advigil.functions.responses import parse_explanation
from advigil.functions.scores import trend_score
from advigil.functions.text import source_label
from advigil.operators.documents import documents_latest_analysis, latest_per_key
from advigil.operators.duplicates import candidate_summary
from advigil.operators.reviews import review_join
from advigil.operators.rules import regulatory_impact
from advigil.operators.support import quality_from_support, support_per_signal

_EMPTY_DUPLICATES = (
    "array<struct<candidate_id:string,report_id_a:string,report_id_b:string,status:string,"
    "similarity_score:double,matched_fields:array<string>,date_proximity_days:int,rationale:string>>"
)


def signal_metrics(signals: DataFrame, stored: DataFrame, support: DataFrame) -> DataFrame:
    """Stored metrics of every signal, else its own values; series stored or computed."""
    base = signals.select(
        "signal_id", F.col("prr").alias("_prr"), F.col("ror").alias("_ror"), "supporting_report_count"
    )
    s = stored.select(
        "signal_id",
        F.struct("prr", "ror", "report_count", "contingency_table", "chi_square", "trend_data").alias("m"),
    )
    series = support.select("signal_id", F.col("trend_data").alias("_series"))
    empty = F.array().cast("array<struct<quarter:string,count:double>>")
    found = F.col("m").isNotNull()
    joined = base.join(s, "signal_id", "left").join(series, "signal_id", "left")
    return joined.select(
        "signal_id",
        F.when(found, F.col("m.prr")).otherwise(F.col("_prr")).alias("prr"),
        F.when(found, F.col("m.ror")).otherwise(F.col("_ror")).alias("ror"),
        F.when(found, F.col("m.report_count")).otherwise(F.col("supporting_report_count")).alias("report_count"),
        F.col("m.contingency_table").alias("contingency_table"),
        F.col("m.chi_square").alias("chi_square"),
        F.coalesce("m.trend_data", "_series", empty).alias("trend_data"),
    )


def signal_detail(
    signals: DataFrame, metrics: DataFrame, releases: DataFrame, reports: DataFrame
) -> DataFrame:
    """Signal, metrics, release facts, source label and limitations.

    The detail recomputes the trend score from the series.
    """
    m = metrics.select("signal_id", "chi_square", "trend_data")
    r = releases.select(
        F.col("release_id").alias("dataset_version"), "processing_version", "import_date"
    )
    sources = (
        reports.groupBy(F.col("report_quarter").alias("dataset_version"))
        .agg(F.min("source").alias("source"))
        .select("dataset_version", source_label(F.col("source")).alias("dataset_source"))
    )
    limits = texts.limitations_or_default(F.col("known_limitations"))
    base = signals if "known_limitations" in signals.columns else signals.withColumn(
        "known_limitations", F.lit(None).cast("array<string>")
    )
    return (
        base.join(m, "signal_id", "left")
        .join(r, "dataset_version", "left")
        .join(sources, "dataset_version", "left")
        .withColumn("trend_score", trend_score(F.col("trend_data")))
        .withColumn("known_limitations", limits)
        .withColumn("human_review_required", F.lit(True))
    )


def evidence_bundle(
    signals: DataFrame,
    stored_metrics: DataFrame,
    reports: DataFrame,
    duplicates: DataFrame,
    scope: str = "release",
) -> DataFrame:
    """Signal, metrics, quality, duplicates and rules, for all signals at once.

    Reports are aggregated per signal once; quality, series and rules share it.
    Candidates come as a count and the first three; the full list is its own table.
    """
    support = support_per_signal(signals, reports, scope)
    quality = quality_from_support(signals, support)
    metrics = signal_metrics(signals, stored_metrics, support).select(
        "signal_id",
        F.struct("prr", "ror", "report_count", "contingency_table", "chi_square", "trend_data").alias("metrics"),
    )
    impact = regulatory_impact(signals, quality)
    dup = candidate_summary(duplicates)
    q = quality.select(
        "signal_id", F.struct(*[c for c in quality.columns if c != "signal_id"]).alias("case_quality")
    )
    base = signals.select(
        "signal_id",
        "drug_name",
        "event_name",
        "supporting_report_count",
        F.col("prr").alias("_prr"),
        "candidate_status",
        "priority_level",
        "risk_score",
        "trend_score",
        "dataset_version",
        *(["known_limitations"] if "known_limitations" in signals.columns else []),
    )
    if "known_limitations" not in base.columns:
        base = base.withColumn("known_limitations", F.lit(None).cast("array<string>"))
    return (
        base.join(metrics, "signal_id", "left")
        .join(q, "signal_id", "left")
        .join(impact, "signal_id", "left")
        .join(dup, "signal_id", "left")
        .withColumn("duplicate_count", F.coalesce("duplicate_count", F.lit(0)))
        .withColumn("duplicates", F.coalesce("duplicates", F.array().cast(_EMPTY_DUPLICATES)))
        .withColumn("known_limitations", texts.limitations_or_default(F.col("known_limitations")))
        .withColumn(
            "why_flagged",
            texts.why_flagged(
                F.col("drug_name"), F.col("event_name"), F.col("supporting_report_count"), F.col("_prr")
            ),
        )
        .drop("_prr")
    )


def fact_map(bundle: DataFrame) -> DataFrame:
    """One struct of 20 facts per signal, with the hash of the struct."""
    m, q = "metrics", "case_quality"
    facts = F.struct(
        "signal_id",
        "drug_name",
        "event_name",
        "candidate_status",
        "priority_level",
        "risk_score",
        "dataset_version",
        F.col(f"{m}.report_count").alias("report_count"),
        F.col(f"{m}.prr").alias("prr"),
        F.col(f"{m}.ror").alias("ror"),
        F.col(f"{m}.chi_square").alias("chi_square"),
        F.col(f"{m}.contingency_table").alias("contingency_table"),
        F.col("trend_score").alias("trend_score"),
        F.col(f"{m}.trend_data").alias("trend_data"),
        F.col(q).alias("case_quality"),
        "duplicate_count",
        F.slice("duplicates", 1, 3).alias("duplicate_sample"),
        "known_limitations",
        F.col("review_areas").alias("regulatory_review_areas"),
        F.col("rule_matches").alias("regulatory_rule_matches"),
    )
    return bundle.select("signal_id", facts.alias("facts")).withColumn(
        "prompt_hash", facts_hash(F.col("facts"))
    )


def evidence_sentences(bundle: DataFrame) -> DataFrame:
    """The deterministic one-line summary of every bundle."""
    facts = {
        "report_count": F.col("metrics.report_count"),
        "prr": F.col("metrics.prr"),
        "ror": F.col("metrics.ror"),
        "chi_square": F.col("metrics.chi_square"),
        "quality_score": F.col("case_quality.quality_score"),
        "total_reports": F.col("case_quality.total_reports"),
        "missing_age_count": F.col("case_quality.missing_age_count"),
        "missing_sex_count": F.col("case_quality.missing_sex_count"),
        "missing_date_count": F.col("case_quality.missing_date_count"),
        "quality_flags": F.col("case_quality.quality_flags"),
        "duplicate_count": F.col("duplicate_count"),
        "trend_data": F.col("metrics.trend_data"),
        "review_areas": F.col("review_areas"),
        "rule_matches": F.col("rule_matches"),
    }
    return bundle.withColumn("evidence_sentence", texts.evidence_sentence(facts))


def explain_responses(responses: DataFrame, bundle: DataFrame) -> DataFrame:
    """Parsed explanations of a table of stored responses (signal_id, response)."""
    facts = evidence_sentences(bundle).select(
        "signal_id", "drug_name", "event_name", "known_limitations", "evidence_sentence", "case_quality"
    )
    parsed = parse_explanation(
        F.col("response"),
        F.col("drug_name"),
        F.col("event_name"),
        F.col("known_limitations"),
        F.col("evidence_sentence"),
        F.col("case_quality").isNotNull(),
    )
    keys = [c for c in responses.columns if c != "response"]
    return responses.join(facts, "signal_id").select(*keys, parsed.alias("e")).select(*keys, "e.*")


def investigation_summary(
    bundle: DataFrame,
    reviews: DataFrame,
    explanations: DataFrame,
    documents: DataFrame,
    analyses: DataFrame,
) -> DataFrame:
    """Bundle, review, latest explanation and document counts of every signal.

    The documents themselves stay rows of ``documents_latest_analysis``.
    """
    review = review_join(bundle, reviews).select(
        "signal_id", F.struct("review_status", "evidence_checklist", "reviewer_notes", "reviewer_conclusion", "items_done").alias("human_review")
    )
    latest = latest_per_key(explanations, "signal_id").select(
        "signal_id",
        F.struct("why_flagged", "evidence_summary", "limitations", "suggested_questions", "model_used", "created_at").alias("ai_explanation"),
    )
    docs = documents_latest_analysis(documents, analyses).groupBy("signal_id").agg(
        F.count(F.lit(1)).alias("document_count"),
        F.count("analysis_id").alias("analysed_document_count"),
        F.count("potential_coverage_gap").alias("coverage_gap_count"),
    )
    out = (
        bundle.join(review, "signal_id", "left")
        .join(latest, "signal_id", "left")
        .join(docs, "signal_id", "left")
    )
    for c in ("document_count", "analysed_document_count", "coverage_gap_count"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    return out.withColumn("human_review_required", F.lit(True))
