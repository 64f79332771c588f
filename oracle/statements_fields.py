"""Statements for files and fields."""

from __future__ import annotations

from advigil.schemas import RAW
from oracle.base import drug_name, event_date, event_name, ingest_age, over, r6, signal_id, two, age_years, sex

TYPO = "Underreporting and reporting biasare inherent limitations"
FIXED = "Underreporting and reporting biases are inherent limitations"
DEFAULTS = (
    "FAERS reports represent spontaneous reports and do not prove causality.|"
    "Underreporting and reporting bias are inherent limitations of spontaneous data."
)

# Cells of each report file that the tables fill; the rest is empty.
RAW_CELLS = {
    "DEMO": ("primaryid", "caseid", "caseversion", "event_dt", "age", "age_cod", "sex"),
    "DRUG": ("primaryid", "caseid", "drug_seq", "role_cod", "drugname"),
    "REAC": ("primaryid", "caseid", "pt"),
    "OUTC": ("primaryid", "caseid", "outc_cod"),
}


def raw_line(kind: str) -> str:
    cells = ", ".join(c if c in RAW_CELLS[kind] else "''" for c in RAW[kind].names)
    return f"SELECT '{kind}' AS kind, concat_ws('$', {cells}) AS line FROM {kind.lower()}"


SQL = {
    "scan_faers_table": over("SELECT primaryid, caseid, caseversion, event_dt, age, age_cod, sex FROM demo WHERE caseversion <> '5'"),
    "scan_quoted_cells": """SELECT CAST(doc_id AS VARCHAR) AS primaryid, length(text) AS characters, md5(text) AS digest, lang AS drug_rec_act FROM documents""",
    "natural_key_sort": over(
        """SELECT primaryid, caseid, drugname, row_number() OVER (PARTITION BY primaryid, caseid ORDER BY CAST(drug_seq AS INTEGER) DESC, drugname) AS place FROM drug"""
    ),
    "primary_drug_in_file_order": over(
        """SELECT primaryid, upper(trim(drugname)) AS drug_name FROM drug QUALIFY row_number() OVER
        (PARTITION BY primaryid ORDER BY role_cod <> 'PS', CAST(drug_seq AS INTEGER) DESC, drugname) = 1"""
    ),
    "scan_faers_unquoted": over("SELECT primaryid, role_cod, drugname, count(*) AS rows FROM drug GROUP BY 1, 2, 3"),
    "load_stats": over(
        """SELECT 'DEMO' AS kind, count(*) AS scanned_data_lines, count(*) FILTER (caseversion <> '5') AS loaded_rows,
        count(*) FILTER (caseversion = '5') AS skipped_bad_lines, 0::BIGINT AS malformed_rows_kept,
        count(*) FILTER (caseversion <> '5') AS accepted_rows, count(*) FILTER (caseversion = '5') AS rejected_rows FROM demo"""
    ),
    "validate_header": "SELECT count(*) AS data_lines, true AS header_ok FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "validate_keys": over("SELECT primaryid, count(*) AS rows FROM reac GROUP BY 1"),
    "scan_deleted_cases": over("SELECT caseid FROM deleted"),
    "scan_quarter": over(
        """SELECT 'demo' AS stage, count(*) AS rows FROM demo UNION ALL SELECT 'drug', count(*) FROM drug
        UNION ALL SELECT 'reac', count(*) FROM reac UNION ALL SELECT 'outc', count(*) FROM outc
        UNION ALL SELECT 'deleted', 0"""
    ),
    "find_quarter_members": over(
        """SELECT count(*) AS data_lines, 'DEMO26Q1.txt' AS member FROM demo UNION ALL SELECT count(*), 'DRUG26Q1.txt' FROM drug
        UNION ALL SELECT count(*), 'REAC26Q1.txt' FROM reac UNION ALL SELECT count(*), 'OUTC26Q1.txt' FROM outc"""
    ),
    "encoding_fallback": r"""
        SELECT lang, count(*) AS documents, CAST(sum(length(regexp_replace(text, '[\r\n$]+', ' ', 'g'))) AS BIGINT) AS characters,
          e AS written_as, e AS read_as FROM documents, (SELECT unnest(['UTF-8', 'ISO-8859-1']) AS e) GROUP BY lang, e""",
    "scan_signals_json": over(
        f"SELECT signal_id, drug_name, event_name, supporting_report_count, {r6('prr')} AS prr, {r6('ror')} AS ror, 'candidate' AS candidate_status FROM cands"
    ),
    "scan_signals_array": over(
        f"SELECT signal_id, drug_name || ' \"}}[{{' AS drug_name, event_name, a AS supporting_report_count, {r6('prr')} AS prr FROM metrics"
    ),
    "scan_metrics_csv": over(
        f"""SELECT signal_id, {r6('chi_square')} AS chi_square, {r6('prr_lower')} AS prr_lower, {r6('prr_upper')} AS prr_upper,
        {r6('ror_lower')} AS ror_lower, {r6('ror_upper')} AS ror_upper FROM metrics"""
    ),
    "parse_reactions_cell_json_and_text": over(
        """SELECT primaryid, array_to_string(list(u ORDER BY pt), '|') AS from_text, array_to_string(list(u ORDER BY pt), '|') AS from_json
        FROM (SELECT DISTINCT primaryid, pt, upper(trim(pt)) AS u FROM reac) GROUP BY 1"""
    ),
    "scan_reports_csv": over(
        f"""SELECT report_id, drug_name, reactions, {r6('patient_age')} AS patient_age, patient_sex, event_date, seriousness,
        seriousness_codes, '2026Q1' AS report_quarter, source FROM reports"""
    ),
    "flatten_openfda_labels": """
        SELECT 1::BIGINT AS total, p_name AS brand_name, upper(p_name) AS generic_name, p_brand AS manufacturer_name, '' AS route,
        '' AS substance_name, CASE WHEN p_size > 25 THEN p_type END AS product_type, 'purpose ' || p_type AS purpose,
        repeat(p_name, 80) AS warnings, substr(repeat(p_name, 80), 1, 500) AS warnings_preview FROM part""",
    "flatten_openfda_events": over(
        """SELECT 1::BIGINT AS total, primaryid AS safetyreportid, event_dt AS receivedate, '' AS serious, '' AS seriousnessdeath,
        age AS patient_age, trim(sex) AS patient_sex, drugs, reactions FROM demo
        JOIN (SELECT primaryid, array_to_string(list_sort(list(DISTINCT trim(drugname))), '|') AS drugs FROM drug GROUP BY 1) USING (primaryid)
        JOIN (SELECT primaryid, array_to_string(list_sort(list(DISTINCT trim(pt))), '|') AS reactions FROM reac GROUP BY 1) USING (primaryid)"""
    ),
    "scan_documents_binary": r"""
        WITH files AS (
          SELECT 'doc' || doc_id || CASE WHEN doc_id % 10 = 3 THEN '.pdf' ELSE '.TXT' END AS filename, text AS t FROM documents
          UNION ALL SELECT 'page' || page_id || '.html', html FROM pages),
        checked AS (
          SELECT filename, lower(regexp_extract(filename, '\.([^.]*)$', 1)) AS file_type, strlen(t) AS file_size_bytes, t FROM files),
        judged AS (
          SELECT *, CASE WHEN file_type NOT IN ('pdf', 'docx', 'txt') THEN 'unsupported_format'
            WHEN file_type = 'pdf' THEN 'corrupted' WHEN contains(t, chr(0)) THEN 'corrupted' ELSE 'accepted' END AS status FROM checked)
        SELECT filename, file_type, file_size_bytes, status, file_size_bytes > 20000 AS over_size,
          CASE WHEN status = 'accepted' THEN length(regexp_replace(t, '^\s+|\s+$', '', 'g')) END AS text_length,
          CASE WHEN status = 'accepted' THEN least(500, length(regexp_replace(t, '^\s+|\s+$', '', 'g'))) END AS preview_length FROM judged""",
    "write_dataset_csv": over(
        "SELECT report_id, drug_name, reactions, patient_sex, seriousness, nullif(seriousness_codes, '') AS seriousness_codes, report_quarter FROM reports"
    ),
    "write_records_json": over(
        "SELECT report_id, drug_name, patient_sex IS NULL AS null_sex_written, true AS keys_sorted FROM reports"
    ),
    "validate_records": over(
        """SELECT 'source differs from FDA_FAERS' AS violation, count(*) AS rows FROM reports WHERE patient_age > 80 HAVING count(*) > 0
        UNION ALL SELECT 'seriousness not in value list', count(*) FROM reports WHERE patient_sex = 'F' HAVING count(*) > 0
        UNION ALL SELECT 'report_quarter must not be null', count(*) FROM reports WHERE event_date IS NULL HAVING count(*) > 0"""
    ),
    "quality_ledger": over(
        """SELECT 'preprocess/demo' AS stage, 'demo_rows' AS reason, count(*) AS count FROM typed
        UNION ALL SELECT 'preprocess/demo', 'event_date_missing_or_invalid', count(*) FROM typed WHERE event_date IS NULL
        UNION ALL SELECT 'preprocess/demo', 'age_missing_or_invalid', count(*) FROM typed WHERE patient_age IS NULL
        UNION ALL SELECT 'preprocess/demo', 'sex_not_f_or_m', count(*) FROM typed WHERE patient_sex IS NULL
        UNION ALL SELECT 'case_processing/case_version', 'older versions', (SELECT count(*) FROM demo) - (SELECT count(*) FROM cases)"""
    ),
    "ledger_totals": over(
        """SELECT n + missing AS total_exclusions, missing AS total_rejected FROM (
        SELECT count(*) AS n, count(*) FILTER (event_date IS NULL) + count(*) FILTER (patient_age IS NULL)
          + count(*) FILTER (patient_sex IS NULL) + (SELECT count(*) FROM demo) - (SELECT count(*) FROM cases) AS missing FROM typed)"""
    ),
    "run_manifest": over(
        """SELECT '2026Q1' AS quarter, 'completed' AS outcome, (SELECT count(*) FROM cases) AS cases, 4 AS files,
        (SELECT count(*) FROM demo) + (SELECT count(*) FROM drug) + (SELECT count(*) FROM reac) + (SELECT count(*) FROM outc) AS loaded_rows,
        0::BIGINT AS rejected_rows, 2.0::DOUBLE AS min_prr"""
    ),
    "manifest_files": over(
        f""", lines AS ({' UNION ALL '.join(raw_line(kind) for kind in RAW_CELLS)}), hashed AS (SELECT kind, sha256(line) AS h FROM lines)
        SELECT kind, count(*) AS loaded_rows, 0::BIGINT AS rejected_rows, CAST(count(*) AS VARCHAR) || ':'
          || {" || ':' || ".join(f"CAST(sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS BIGINT)) AS VARCHAR)" for i in range(4))} AS digest
        FROM hashed GROUP BY kind"""
    ),
    "reconciliation": over(
        """SELECT 'raw_demo_rows' AS stage, count(*) AS rows FROM demo UNION ALL SELECT 'raw_drug_rows', count(*) FROM drug
        UNION ALL SELECT 'raw_reac_rows', count(*) FROM reac UNION ALL SELECT 'cases_after_version_handling', count(*) FROM cases
        UNION ALL SELECT 'metrics_rows', count(*) FROM metrics UNION ALL SELECT 'candidates', count(*) FROM cands"""
    ),
    "to_numeric": f"""
        SELECT o_orderkey, {r6("CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 1 THEN o_custkey * 10.0::DOUBLE END")} AS number FROM orders""",
    "parse_event_date": over(
        f"""SELECT primaryid, {event_date("raw")} AS event_date FROM (
        SELECT primaryid, CASE WHEN age_cod = 'DY' THEN replace(event_dt, '0701', '1345') ELSE event_dt || ' ' END AS raw FROM demo)"""
    ),
    "parse_age_years": over(f"SELECT primaryid, {r6(age_years('age', 'age_cod'))} AS patient_age FROM demo"),
    "normalize_age_ingest": over(
        f"""SELECT primaryid, {r6(ingest_age("age", "code"))} AS patient_age FROM (SELECT *, '80' || caseversion AS code FROM demo)"""
    ),
    "parse_sex": over(
        f"""SELECT primaryid, {sex('sex')} AS patient_sex, CASE WHEN trim(sex) = 'm' THEN 'M' WHEN sex = 'F' THEN 'F' END AS ingest_sex FROM demo"""
    ),
    "type_demo": over(
        f"""SELECT primaryid, caseid, caseversion, report_id, event_date, {r6('patient_age')} AS patient_age, patient_sex, report_quarter, source FROM typed"""
    ),
    "demo_audit": over(
        """SELECT count(*) AS demo_rows, count(*) FILTER (event_date IS NULL) AS event_date_missing_or_invalid,
        count(*) FILTER (patient_age IS NULL) AS age_missing_or_invalid, count(*) FILTER (patient_sex IS NULL) AS sex_not_f_or_m FROM typed"""
    ),
    "normalize_drug_name": over(f"SELECT drugname, {drug_name('drugname')} AS drug_name, count(*) AS rows FROM drug GROUP BY 1, 2"),
    "normalize_reaction": over(f"SELECT pt, {event_name('pt')} AS event_name, count(*) AS rows FROM reac GROUP BY 1, 2"),
    "signal_id": over(f"SELECT drug_name, event_name, {signal_id('drug_name', 'event_name')} AS signal_id FROM counts"),
    "safe_float": f"""
        SELECT c_custkey, {r6("CASE WHEN c_custkey % 3 = 2 THEN c_acctbal END")} AS safe,
        {r6("CASE WHEN c_acctbal >= 0 THEN c_acctbal END")} AS non_negative, CAST(trunc(c_acctbal) AS BIGINT) AS whole FROM customer""",
    "parse_trend_data": """
        WITH per AS (SELECT user_id, '20' || lpad(CAST(user_id % 30 AS VARCHAR), 2, '0') || 'Q' || CAST(day(ts) % 5 + 1 AS VARCHAR) AS quarter,
            count(*) AS n FROM events GROUP BY 1, 2)
        SELECT user_id, CASE WHEN user_id % 7 <> 0 THEN string_agg(quarter || '=' || n, ';' ORDER BY quarter) END AS series FROM per GROUP BY 1""",
    "clean_trend_points": f"""
        WITH per AS (SELECT user_id, '20' || lpad(CAST(user_id % 30 AS VARCHAR), 2, '0') || 'Q' || CAST(day(ts) % 5 + 1 AS VARCHAR) AS quarter,
            count(*) AS n FROM events GROUP BY 1, 2),
        kept AS (SELECT * FROM per WHERE right(quarter, 1) BETWEEN '1' AND '4')
        SELECT user_id, quarter, {r6('n::DOUBLE')} AS count, {r6('n::DOUBLE / max(n) OVER (PARTITION BY user_id)')} AS width FROM kept""",
    "parse_duplicate_rationale": over(
        """SELECT candidate_id, drug_name AS drug, event_name AS event, regexp_replace(CAST(age AS VARCHAR), '\\.0$', '') AS age, sex,
        strftime(CAST(date AS DATE), '%d %b %Y') AS event_date FROM dups JOIN wide USING (signal_id)"""
    ),
    "format_matched_fields": over(
        """SELECT report_id, drug_name, CASE n WHEN 0 THEN '--' WHEN 1 THEN x WHEN 2 THEN replace(x, '|', ', and ')
          ELSE regexp_replace(x, '\\|([^|]*)\\|', ', \\1, and ') END AS missing FROM (
        SELECT report_id, drug_name, concat_ws('|', CASE WHEN patient_age IS NULL THEN 'patient age' END,
          CASE WHEN patient_sex IS NULL THEN 'sex' END, CASE WHEN event_date IS NULL THEN 'event date' END) AS x,
          (patient_age IS NULL)::INT + (patient_sex IS NULL)::INT + (event_date IS NULL)::INT AS n FROM reports)"""
    ),
    "why_flagged": over(
        f"""SELECT signal_id, drug_name || ' and ' || event_name || ' form a candidate signal supported by ' || a || ' reports with a PRR of '
        || {two(r6('prr'))} || '.' AS why_flagged FROM metrics"""
    ),
    "dataset_source_label": over("SELECT report_quarter, 'FDA FAERS' AS dataset_source FROM reports GROUP BY 1"),
    "limitations_default": over(
        f"SELECT signal_id, CASE WHEN priority_level = 'low' THEN '{FIXED} of ' || drug_name ELSE '{DEFAULTS}' END AS limitations FROM sig"
    ),
    "column_alias_fill": over("SELECT signal_id, drug_name, event_name, supporting_report_count FROM cands"),
    "fact_map": over(
        f"""SELECT q.signal_id, drug_name, event_name, candidate_status, supporting_report_count AS report_count, {r6('prr')} AS prr,
        {r6('CASE WHEN prr >= 2.1 THEN m.chi_square END')} AS chi_square, series AS trend, {r6('quality_score')} AS quality_score,
        coalesce(duplicate_count, 0) AS duplicate_count, least(3, coalesce(duplicate_count, 0)) AS sample_size,
        coalesce(n, 0) AS rule_matches
        FROM sig s JOIN quality q USING (signal_id) JOIN (SELECT signal_id, chi_square FROM metrics) m USING (signal_id)
        LEFT JOIN sig_dup_counts USING (signal_id) LEFT JOIN (SELECT signal_id, count(*) AS n FROM matches GROUP BY 1) USING (signal_id)"""
    ),
    "prompt_hash": over(
        """SELECT signal_id, sha256('{"drug_name":"' || drug_name || '","event_name":"' || event_name || '","priority_level":'
        || coalesce('"' || priority_level || '"', 'null') || ',"signal_id":"' || signal_id || '"}') AS prompt_hash FROM sig"""
    ),
    "document_prompt_hash": over(
        """SELECT document_id, sha256('{"doc_id":"' || document_id || '","signal":' || CASE WHEN docs.signal_id IS NULL THEN 'null' ELSE
          '{"drug_name":' || coalesce(CAST(to_json(c.drug_name) AS VARCHAR), 'null') || ',"event_name":' || coalesce(CAST(to_json(c.event_name) AS VARCHAR), 'null')
          || ',"priority_level":null,"prr":' || coalesce(CAST(c.prr AS VARCHAR), 'null') || ',"report_count":' || coalesce(CAST(c.supporting_report_count AS VARCHAR), 'null')
          || ',"review_areas":' || CASE WHEN c.signal_id IS NULL THEN 'null' ELSE '["Product Label","PSUR / PBRER","Risk Management Plan (RMP)","Reference Safety Information (RSI)"]' END
          || ',"signal_id":"' || docs.signal_id || '"}' END || ',"text":' || CAST(to_json(text) AS VARCHAR) || '}') AS prompt_hash
        FROM docs LEFT JOIN cands c USING (signal_id)"""
    ),
    "evidence_sentence": over(
        """SELECT signal_id, CAST(supporting_report_count AS VARCHAR) AS reports,
        'score=' || CAST(quality_score AS VARCHAR) || ', reports=' || total_reports || ', missing_age=' || missing_age_count || ', missing_sex='
          || missing_sex_count || ', missing_event_date=' || missing_date_count || ', flags='
          || CASE WHEN quality_flags = '' THEN '[]' ELSE '[''' || replace(quality_flags, '|', ''', ''') || ''']' END AS quality,
        coalesce(series_text, '[]') AS trend, CAST(coalesce(n, 0) AS VARCHAR) AS matches
        FROM sig JOIN quality USING (signal_id) LEFT JOIN (SELECT signal_id, count(*) AS n FROM matches GROUP BY 1) USING (signal_id)"""
    ),
    "parse_explanation_json": r"""
        SELECT conv_id, turn, CASE WHEN conv_id % 3 < 2 THEN 'turn ' || turn ELSE t END AS why_flagged,
        'Deterministic evidence: facts. AI interpretation: ' || CASE WHEN conv_id % 3 < 2 THEN text ELSE t END AS evidence_summary,
        CASE WHEN conv_id % 3 < 2 THEN role ELSE 'known' END AS limitations,
        CASE WHEN conv_id % 3 < 2 THEN '' ELSE 'Review detailed case narratives.' END AS questions
        FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations)""",
    "filter_contradictory_limitations": """
        SELECT conv_id, turn, concat_ws('|', CASE WHEN turn % 2 = 1 OR NOT denies THEN text END,
          CASE WHEN turn % 2 = 1 THEN 'Quality of ' || role || ' data is unavailable' END,
          CASE WHEN turn % 2 = 1 THEN 'No case missing-field counts' END, 'Quality is fine') AS limitations
        FROM (SELECT *, (contains(lower(text), 'quality') OR contains(lower(text), 'missing-field') OR contains(lower(text), 'missing field'))
          AND (contains(lower(text), 'not available') OR contains(lower(text), 'unavailable') OR contains(lower(text), 'no case')) AS denies FROM conversations)""",
    "parse_document_analysis_json": """
        SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'S' || turn || ':Safety relevance|plain:Identified section'
          ELSE 'General Safety:Automated fallback parsing of document analysis.' END AS sections,
        CASE WHEN conv_id % 2 = 0 THEN 'completed' ELSE 'needs_review' END AS analysis_status,
        CASE WHEN conv_id % 2 = 1 THEN 'Potential coverage gap requires human expert verification.' END AS gap
        FROM conversations""",
    "page_count": over(
        "SELECT report_quarter, count(*) AS reports, greatest(1, CAST(ceil(count(*) / 50.0::DOUBLE) AS BIGINT)) AS pages FROM reports GROUP BY 1"
    ),
    "document_context": over(
        f"""SELECT CAST(doc_id AS VARCHAR) AS document_id, d.signal_id, drug_name, event_name, supporting_report_count AS report_count, {r6('prr')} AS prr
        FROM (SELECT doc_id, CASE lang WHEN 'en' THEN {signal_id("'BLUE ANVIL'", "'SUPPLIER#000000000'")} WHEN 'fr' THEN 'SIG-0000000000' END AS signal_id FROM documents) d
        LEFT JOIN cands USING (signal_id)"""
    ),
}
