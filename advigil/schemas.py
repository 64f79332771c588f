"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

from advigil import fixed_values as V


def text_schema(columns: tuple[str, ...]) -> T.StructType:
    """A layout in which every cell is text."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


RAW = {
    "DEMO": text_schema(V.DEMO_COLUMNS),
    "DRUG": text_schema(V.DRUG_COLUMNS),
    "REAC": text_schema(V.REAC_COLUMNS),
    "OUTC": text_schema(V.OUTC_COLUMNS),
}
REQUIRED_TABLES = ("DEMO", "DRUG", "REAC")

_s, _d, _l, _i, _b = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()


def _table(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


TREND = T.ArrayType(_table(("quarter", _s, True), ("count", _d, True)))
STRINGS = T.ArrayType(_s)

SIGNAL = _table(
    ("signal_id", _s, False),
    ("drug_name", _s, False),
    ("event_name", _s, False),
    ("supporting_report_count", _l, False),
    ("prr", _d, False),
    ("ror", _d, True),
    ("trend_score", _d, True),
    ("risk_score", _d, True),
    ("priority_level", _s, True),
    ("candidate_status", _s, False),
    ("dataset_version", _s, True),
)
SIGNAL_STORED = T.StructType(
    SIGNAL.fields + [T.StructField("rank", _i), T.StructField("known_limitations", STRINGS)]
)
REPORT = _table(
    ("report_id", _s, False),
    ("drug_name", _s, False),
    ("reactions", STRINGS, False),
    ("patient_age", _d, True),
    ("patient_sex", _s, True),
    ("event_date", _s, True),
    ("seriousness", _s, False),
    ("seriousness_codes", STRINGS, False),
    ("report_quarter", _s, False),
    ("source", _s, True),
)
SIGNAL_METRICS = _table(
    ("signal_id", _s, False),
    ("prr", _d, False),
    ("ror", _d, True),
    ("report_count", _l, False),
    ("contingency_table", _table(("a", _l, True), ("b", _l, True), ("c", _l, True), ("d", _l, True)), True),
    ("trend_data", TREND, True),
    ("chi_square", _d, True),
)
METRICS_FILE = _table(
    ("signal_id", _s, True),
    ("chi_square", _d, True),
    ("prr_lower", _d, True),
    ("prr_upper", _d, True),
    ("ror_lower", _d, True),
    ("ror_upper", _d, True),
    ("trend_data", _s, True),
)
INDICATORS = T.ArrayType(
    _table(("flag", _s, True), ("description", _s, True), ("impact_level", _s, True))
)
CASE_QUALITY = _table(
    ("signal_id", _s, False),
    ("total_reports", _l, False),
    ("missing_age_count", _l, False),
    ("missing_sex_count", _l, False),
    ("missing_date_count", _l, False),
    ("quality_score", _d, False),
    ("quality_flags", STRINGS, False),
    ("indicators", INDICATORS, False),
)
DUPLICATE = _table(
    ("candidate_id", _s, False),
    ("signal_id", _s, True),
    ("report_id_a", _s, False),
    ("report_id_b", _s, False),
    ("rationale", _s, False),
    ("similarity_score", _d, True),
    ("drug_similarity", _d, True),
    ("event_similarity", _d, True),
    ("date_proximity_days", _i, True),
    ("matched_fields", STRINGS, False),
    ("status", _s, False),
)
RELEASE = _table(
    ("release_id", _s, False),
    ("quarter", _s, False),
    ("dataset_release", _s, False),
    ("import_date", T.DateType(), False),
    ("processing_version", _s, False),
    ("total_reports", _l, True),
    ("processed_at", T.TimestampType(), True),
)
INGEST_BATCH = _table(
    ("quarter", _s, False),
    ("batch", T.IntegerType(), False),
    ("batches", T.IntegerType(), False),
    ("reports", _l, False),
    ("committed_at", T.TimestampType(), True),
)
CHECKLIST = _table(*[(c, _b, True) for c in V.CHECKLIST_ITEMS])
REVIEW = _table(
    ("review_id", _s, True),
    ("signal_id", _s, False),
    ("review_status", _s, False),
    ("evidence_checklist", CHECKLIST, True),
    ("reviewer_notes", _s, True),
    ("reviewer_conclusion", _s, True),
    ("created_at", T.TimestampType(), True),
    ("updated_at", T.TimestampType(), True),
)
PAIR_COUNTS = _table(
    ("drug_name", _s, False), ("event_name", _s, False), ("count", _l, False), ("quarter", _s, True)
)
EXPLANATION = _table(
    ("summary_id", _s, False),
    ("signal_id", _s, False),
    ("why_flagged", _s, True),
    ("evidence_summary", _s, True),
    ("limitations", STRINGS, True),
    ("suggested_questions", STRINGS, True),
    ("model_used", _s, True),
    ("prompt_hash", _s, True),
    ("created_at", T.TimestampType(), True),
)
SECTIONS = T.ArrayType(_table(("section_name", _s, True), ("relevance_reason", _s, True)))
DOCUMENT = _table(
    ("document_id", _s, False),
    ("filename", _s, False),
    ("file_type", _s, True),
    ("file_size_bytes", _l, True),
    ("signal_id", _s, True),
    ("extracted_text", _s, True),
    ("extracted_text_preview", _s, True),
    ("status", _s, True),
    ("created_at", T.TimestampType(), True),
)
DOCUMENT_ANALYSIS = _table(
    ("analysis_id", _s, False),
    ("document_id", _s, False),
    ("signal_id", _s, True),
    ("relevant_sections", SECTIONS, True),
    ("existing_related_content", _s, True),
    ("potential_coverage_gap", _s, True),
    ("analysis_status", _s, True),
    ("human_review_required", _b, True),
    ("created_at", T.TimestampType(), True),
)
