"""Parsing of stored model responses (JSON text, possibly fenced or broken)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from advigil import fixed_values as V
from advigil.functions.text import fill_template
from advigil.functions.texts import without_contradictions

_EXPLANATION = (
    "why_flagged string, evidence_summary string, limitations array<string>, "
    "suggested_questions array<string>, _broken string"
)
_ANALYSIS = (
    "relevant_sections array<string>, existing_related_content string, "
    "potential_coverage_gap string, analysis_status string, _broken string"
)
_LENIENT = {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}


def without_fences(text: Column) -> Column:
    """White space trimmed and a surrounding code fence removed."""
    t = F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")
    opened = F.regexp_replace(t, r"^```(?:json)?\s*", "")
    return F.when(t.startswith("```"), F.regexp_replace(opened, r"\s*```$", "")).otherwise(t)


def parse_explanation(
    text: Column,
    drug: Column,
    event: Column,
    known_limitations: Column,
    evidence: Column,
    quality_present: Column,
) -> Column:
    """Four fields of an explanation, with defaults per key and a fallback record."""
    cleaned = without_fences(text)
    record = F.from_json(cleaned, _EXPLANATION, _LENIENT)
    broken = record["_broken"].isNotNull() | record.isNull()
    default_limits = F.coalesce(known_limitations, F.array(F.lit(V.EXPLANATION_DEFAULT_LIMITATION)))
    why = F.when(broken, cleaned).otherwise(
        F.coalesce(
            record["why_flagged"],
            fill_template(V.EXPLANATION_DEFAULT_REASON, drug=drug, event=event),
        )
    )
    body = F.when(broken, cleaned).otherwise(
        F.coalesce(record["evidence_summary"], F.lit(V.EXPLANATION_DEFAULT_SUMMARY))
    )
    limits = F.when(broken, default_limits).otherwise(
        F.coalesce(record["limitations"], known_limitations, F.array())
    )
    questions = F.when(broken, F.array(F.lit(V.EXPLANATION_DEFAULT_QUESTION))).otherwise(
        F.coalesce(record["suggested_questions"], F.array().cast("array<string>"))
    )
    return F.struct(
        why.alias("why_flagged"),
        fill_template(V.EXPLANATION_PREFIX, evidence=evidence, text=body).alias("evidence_summary"),
        without_contradictions(limits, quality_present).alias("limitations"),
        questions.alias("suggested_questions"),
    )


def _section(text: Column) -> Column:
    """An element is an object with two keys or a plain name."""
    as_object = F.from_json(text, "section_name string, relevance_reason string")
    is_object = F.trim(text).startswith("{")
    return F.struct(
        F.when(is_object, F.coalesce(as_object["section_name"], F.lit(V.SECTION_NAME)))
        .otherwise(text)
        .alias("section_name"),
        F.when(is_object, F.coalesce(as_object["relevance_reason"], F.lit(V.SECTION_REASON)))
        .otherwise(F.lit(V.SECTION_TEXT_REASON))
        .alias("relevance_reason"),
    )


def parse_document_analysis(text: Column) -> Column:
    """Sections, related content, coverage gap and status of a document analysis."""
    cleaned = without_fences(text)
    record = F.from_json(cleaned, _ANALYSIS, _LENIENT)
    broken = record["_broken"].isNotNull() | record.isNull()
    fallback = F.array(
        F.struct(
            F.lit(V.FALLBACK_SECTION_NAME).alias("section_name"),
            F.lit(V.FALLBACK_SECTION_REASON).alias("relevance_reason"),
        )
    )
    sections = F.transform(
        F.coalesce(record["relevant_sections"], F.array().cast("array<string>")), _section
    )
    status = F.when(
        record["analysis_status"].isin(*V.ANALYSIS_STATUSES), record["analysis_status"]
    ).otherwise(F.lit("completed"))
    return F.struct(
        F.when(broken, fallback).otherwise(sections).alias("relevant_sections"),
        F.when(broken, cleaned)
        .otherwise(record["existing_related_content"])
        .alias("existing_related_content"),
        F.when(broken, F.lit(V.FALLBACK_COVERAGE))
        .otherwise(record["potential_coverage_gap"])
        .alias("potential_coverage_gap"),
        F.when(broken, F.lit("needs_review")).otherwise(status).alias("analysis_status"),
    )
