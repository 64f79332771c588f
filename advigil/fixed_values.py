"""Fixed values.

Everything in this file is a constant of the report format, of the scoring
policy or of a published text. The values have to be exactly these for the
results to be right, so they are listed plainly and kept together.
"""

# --- fixed values: report file layouts (order matters, every cell is text) ---
DEMO_COLUMNS = (
    "primaryid", "caseid", "caseversion", "i_f_code", "event_dt", "mfr_dt",
    "init_fda_dt", "fda_dt", "rept_cod", "auth_num", "mfr_num", "mfr_sndr",
    "lit_ref", "age", "age_cod", "age_grp", "sex", "e_sub", "wt", "wt_cod",
    "rept_dt", "to_mfr", "occp_cod", "reporter_country", "occr_country",
)
DRUG_COLUMNS = (
    "primaryid", "caseid", "drug_seq", "role_cod", "drugname", "prod_ai",
    "val_vbm", "route", "dose_vbm", "cum_dose_chr", "cum_dose_unit", "dechal",
    "rechal", "lot_num", "exp_dt", "nda_num", "dose_amt", "dose_unit",
    "dose_form", "dose_freq",
)
REAC_COLUMNS = ("primaryid", "caseid", "pt", "drug_rec_act")
OUTC_COLUMNS = ("primaryid", "caseid", "outc_cod")
FIELD_SEPARATOR = "$"
SOURCE_MARKER = "FDA_FAERS"

# --- fixed values: age units -------------------------------------------------
AGE_DIVISORS = {"YR": 1.0, "MON": 12.0, "WK": 52.0, "DY": 365.25, "HR": 8766.0, "DEC": 1.0}
AGE_CODE_FACTORS = {
    "800": 10.0,
    "801": 1.0,
    "802": 1 / 12,
    "803": 1 / 52.18,
    "804": 1 / 365.25,
    "805": 1 / 8766,
}
MAX_PLAUSIBLE_AGE = 130

# --- fixed values: text patterns (Java regular expressions) ------------------
# White space as Unicode defines it, plus the four ASCII separator controls.
WHITESPACE_PATTERN = r"(?U)[\s\x1C-\x1F]+"
# White space that is cut off at the edges of a cell.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
PLAIN_TEXT_EXCEPTION_PATTERN = r"[^\x20-\x7E]|\x20\x20"
EDGE_PUNCTUATION_PATTERN = r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$"
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DAY_PATTERN = r"^\d{8}$"
QUARTER_PATTERN = r"^\d{4}Q[1-4]$"
RATIONALE_PATTERN = (
    r"share drug '([^']+)', event '([^']+)', patient age ([^,]+), sex '([^']+)', "
    r"and event date (\d{4}-\d{2}-\d{2}|\d{8})"
)
ABSENT_DETAIL = "--"

# --- fixed values: outcomes and enumerations ---------------------------------
SERIOUS_OUTCOMES = ("DE", "LT", "HO", "DS", "CA", "RI", "OT")
SERIOUS = "Serious"
NON_SERIOUS = "Non-serious"
UNKNOWN_SERIOUSNESS = "Unknown"
SERIOUSNESS_LEVELS = (SERIOUS, NON_SERIOUS, UNKNOWN_SERIOUSNESS)
PRIORITY_LEVELS = ("low", "medium", "high", "critical")
CANDIDATE_STATUSES = ("candidate", "under_review", "closed")
REVIEW_STATUSES = ("not_started", "in_review", "reviewed")
ANALYSIS_STATUSES = ("completed", "needs_review", "failed")
CHECKLIST_ITEMS = (
    "supporting_reports_reviewed",
    "case_quality_reviewed",
    "reporting_trend_reviewed",
    "duplicates_reviewed",
    "ai_explanation_reviewed",
    "regulatory_documents_reviewed",
)

# --- fixed values: signal identifiers ----------------------------------------
SIGNAL_ID_PREFIX = "SIG-"
SIGNAL_ID_SEPARATOR = "\u001f"
SIGNAL_ID_HEX_LENGTH = 10
DUPLICATE_ID_PREFIX = "DUP-"
DUPLICATE_ID_HEX_LENGTH = 12
DUPLICATE_STATUS = "potential_duplicate"
DUPLICATE_MATCHED_FIELDS = ("drug", "event", "age", "sex", "event_date")
DUPLICATE_RATIONALE = (
    "Potential duplicate review: reports {a} and {b} share drug '{drug}', event '{event}', "
    "patient age {age}, sex '{sex}', and event date {date}. "
    "Exact field overlap is a triage signal only and is not confirmation of duplication."
)

# --- fixed values: texts -----------------------------------------------------
DEFAULT_LIMITATIONS = (
    "FAERS reports represent spontaneous reports and do not prove causality.",
    "Underreporting and reporting bias are inherent limitations of spontaneous data.",
)
LIMITATION_TYPO = "Underreporting and reporting biasare inherent limitations"
LIMITATION_FIXED = "Underreporting and reporting biases are inherent limitations"
WHY_FLAGGED = (
    "{drug} and {event} form a candidate signal supported by {count} reports with a PRR of {prr}."
)
CLUSTER_TEXT = (
    "Cluster {number} of {k}: {size} signal(s) with mean PRR {prr}, mean risk score {risk}. "
    "Signals share similar statistical reporting characteristics. "
    "Requires human pharmacovigilance review."
)
CLUSTER_DISCLAIMER = (
    "Clusters reflect signals with similar observed reporting characteristics. "
    "They do not imply shared biological mechanism, causality, or clinical equivalence. "
    "All cluster findings require qualified pharmacovigilance professional review."
)
NOT_IN_BUNDLE = "NOT AVAILABLE IN EVIDENCE BUNDLE"
EVIDENCE_SENTENCE = (
    "Reports={report_count}; PRR={prr}; ROR={ror}; chi-square={chi_square}; "
    "case quality ({quality}); potential duplicate candidates={duplicate_count}; "
    "trend data={trend_data}; potential review areas={areas}; "
    "deterministic rule matches={matches}."
)
QUALITY_SENTENCE = (
    "score={score}, reports={reports}, missing_age={age}, missing_sex={sex}, "
    "missing_event_date={date}, flags={flags}"
)
EXPLANATION_PREFIX = "Deterministic evidence: {evidence} AI interpretation: {text}"
EXPLANATION_DEFAULT_SUMMARY = "Summary of spontaneous reports."
EXPLANATION_DEFAULT_REASON = "Elevated reporting for {drug} and {event}."
EXPLANATION_DEFAULT_QUESTION = "Review detailed case narratives."
EXPLANATION_DEFAULT_LIMITATION = "Spontaneous reporting bias"
SECTION_NAME = "Section"
SECTION_REASON = "Safety relevance"
SECTION_TEXT_REASON = "Identified section"
FALLBACK_SECTION_NAME = "General Safety"
FALLBACK_SECTION_REASON = "Automated fallback parsing of document analysis."
FALLBACK_COVERAGE = "Potential coverage gap requires human expert verification."
CONTEXT_REVIEW_AREAS = (
    "Product Label",
    "PSUR / PBRER",
    "Risk Management Plan (RMP)",
    "Reference Safety Information (RSI)",
)

# --- fixed values: case quality flags -----------------------------------------
# flag, description suffix, impact level
QUALITY_FLAGS = {
    "high_missing_age": ("% of reports are missing patient age.", "high"),
    "minor_missing_age": ("% of reports are missing patient age.", "low"),
    "high_missing_sex": ("% of reports are missing patient sex.", "medium"),
    "high_missing_date": ("% of reports are missing event onset date.", "high"),
}

# --- fixed values: review rules (id, name, description, document type,
# --- section, default priority, area rationale, confidence rationale) ---------
RULE_TEXTS = {
    "REG-001": (
        "High Disproportionality Label Review",
        "PRR >= 2.5 and report_count >= 10 indicates potential product label review.",
        "Product Label",
        "Section 4.8 Undesirable Effects / Section 4.4 Special Warnings",
        "high",
        "Substantial statistical disproportionality indicates potential unlisted "
        "or under-characterized adverse drug reaction requiring product label evaluation.",
        "Deterministic threshold match based on PRR and report volume.",
    ),
    "REG-002": (
        "Emerging Trend Cumulative Safety Review",
        "Trend score >= 0.50 indicates emerging trend for PSUR/PBRER review.",
        "PSUR / PBRER",
        "Section 16.2 Cumulative Signal Evaluation",
        "high",
        "Accelerating reporting trajectory over consecutive quarters indicates an emerging "
        "safety trend requiring formal cumulative evaluation in upcoming PSUR/PBRER.",
        "Deterministic threshold match based on temporal trend trajectory.",
    ),
    "REG-003": (
        "High Priority Risk Management Review",
        "Priority in ['high', 'critical'] or risk_score >= 0.70 triggers RMP review.",
        "Risk Management Plan (RMP)",
        "Part II: Module SVII - Identified and Potential Risks",
        "high",
        "High priority/risk score profile warrants assessment against existing "
        "pharmacovigilance activities and risk minimization measures in the RMP.",
        "Deterministic rule match based on signal triage priority and risk score.",
    ),
    "REG-004": (
        "Active Candidate Trial Safety Assessment",
        "Active status and report count >= 5 triggers trial RSI assessment.",
        "Reference Safety Information (RSI)",
        "Section 7 Reference Safety Information (Investigator's Brochure)",
        "medium",
        "Active candidate safety signal under investigation requires checking against "
        "expected adverse reaction lists in clinical trial Reference Safety Information.",
        "Deterministic match on active candidate status and supporting reports.",
    ),
    "REG-005": (
        "Case Quality Clinical Documentation Review",
        "Quality score < 0.80 or high missingness triggers CTD safety review.",
        "Relevant CTD safety content",
        "Module 2.7.4 Summary of Clinical Safety / Module 5.3.5.3",
        "medium",
        "Spontaneous report data quality or missingness concerns necessitate targeted clinical "
        "narrative follow-up in CTD clinical safety summary documentation.",
        "Deterministic match on case-quality flags and missingness thresholds.",
    ),
}

# --- fixed values: documents ---------------------------------------------------
MAX_DOCUMENT_BYTES = 10 * 1024 * 1024
DOCUMENT_EXTENSIONS = ("pdf", "docx", "txt")
PREVIEW_LENGTH = 500
WARNING_LENGTH = 500
