"""Statements for the review queue, evidence, duplicates, rules, documents and tables."""

from __future__ import annotations

from oracle.base import level, over, r6, risk, two
from oracle.statements_groups import INGEST_COLUMNS

FACTS = f"""facts AS (
  SELECT signal_id, prr, a * 2 AS n, (a - 6) / 8.0::DOUBLE AS trend_score, least(1.0::DOUBLE, round(prr, 6) / 3) AS risk_score,
    CASE WHEN a > 12 THEN 'critical' WHEN a > 10 THEN 'high' ELSE 'low' END AS lvl,
    CASE a % 5 WHEN 0 THEN 'closed' WHEN 1 THEN 'under_review' ELSE 'candidate' END AS status,
    CASE WHEN a > 3 THEN 0.55::DOUBLE ELSE 0.8::DOUBLE END AS quality_score, a = 2 AS flagged
  FROM metrics),
fired AS (
  SELECT signal_id, 'REG-001' AS rule_id, 'High Disproportionality Label Review' AS rule_name,
    'PRR=' || {two('prr')} || ' (>= 2.5) with ' || n || ' supporting reports (>= 10).' AS condition_matched,
    'Product Label' AS document_type, CASE WHEN prr >= 3.0 THEN 'high' ELSE 'medium' END AS priority, n FROM facts WHERE prr >= 2.5 AND n >= 10
  UNION ALL SELECT signal_id, 'REG-002', 'Emerging Trend Cumulative Safety Review', 'Trend Score=' || {two('trend_score')} || ' (>= 0.50).',
    'PSUR / PBRER', CASE WHEN trend_score >= 0.75 THEN 'high' ELSE 'medium' END, n FROM facts WHERE trend_score >= 0.5
  UNION ALL SELECT signal_id, 'REG-003', 'High Priority Risk Management Review', concat_ws(' and ',
    CASE WHEN lvl <> 'low' THEN 'Priority Level=''' || lvl || '''' END,
    CASE WHEN risk_score >= 0.7 THEN 'Risk Score=' || {two('risk_score')} || ' (>= 0.70)' END),
    'Risk Management Plan (RMP)', 'high', n FROM facts WHERE lvl <> 'low' OR risk_score >= 0.7
  UNION ALL SELECT signal_id, 'REG-004', 'Active Candidate Trial Safety Assessment',
    'Active status=''' || status || ''' with ' || n || ' reports (>= 5).', 'Reference Safety Information (RSI)', 'medium', n
    FROM facts WHERE n >= 5 AND status <> 'closed'
  UNION ALL SELECT signal_id, 'REG-005', 'Case Quality Clinical Documentation Review',
    CASE WHEN quality_score < 0.8 THEN 'Quality Score=0.55 (< 0.80)' ELSE 'Quality Flags=[''high_missing_age'', ''minor'']' END,
    'Relevant CTD safety content', 'medium', n FROM facts WHERE quality_score < 0.8 OR flagged)"""


def facts(select: str) -> str:
    return over("").rstrip() + ",\n" + FACTS + "\n" + select


RULE_NAMES = """(VALUES
    ('REG-001', 'High Disproportionality Label Review', 'Product Label', 'high'),
    ('REG-002', 'Emerging Trend Cumulative Safety Review', 'PSUR / PBRER', 'high'),
    ('REG-003', 'High Priority Risk Management Review', 'Risk Management Plan (RMP)', 'high'),
    ('REG-004', 'Active Candidate Trial Safety Assessment', 'Reference Safety Information (RSI)', 'medium'),
    ('REG-005', 'Case Quality Clinical Documentation Review', 'Relevant CTD safety content', 'medium'))
    AS t(rule_id, rule_name, target_document_type, default_priority)"""
DEFAULTS = (
    "FAERS reports represent spontaneous reports and do not prove causality.|"
    "Underreporting and reporting bias are inherent limitations of spontaneous data."
)
TEXT = """'Potential duplicate review: reports ' || report_id_a || ' and ' || report_id_b || ' share drug ''' || drug_name || ''', event ''' || event_name
    || ''', patient age ' || regexp_replace(CAST(age AS VARCHAR), '\\.0$', '') || ', sex ''' || sex || ''', and event date ' || date
    || '. Exact field overlap is a triage signal only and is not confirmation of duplication.'"""
DONE = "(" + " + ".join(f"(supporting_report_count > {8 + 2 * i})::INT" for i in range(6)) + ")"

SQL = {
    "queue_page": over(
        f"""SELECT signal_id, {r6('prr')} AS prr, supporting_report_count FROM (
        SELECT *, row_number() OVER (ORDER BY prr DESC NULLS LAST, signal_id) AS n FROM sig) WHERE n BETWEEN 11 AND 20"""
    ),
    "queue_page_of_pairs": over(
        "SELECT signal_id, a, drug_name, event_name FROM metrics ORDER BY a DESC NULLS LAST, signal_id LIMIT 100"
    ),
    "queue_sort_ui": over("SELECT signal_id, dataset_version FROM sig ORDER BY dataset_version ASC NULLS LAST, signal_id LIMIT 10"),
    "queue_total": over(
        """SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 20.0::DOUBLE) AS BIGINT)) AS pages,
        count(*) FILTER (candidate_status <> 'closed') AS open_signals FROM sig"""
    ),
    "supporting_reports_page": over(
        """SELECT signal_id, report_id, report_quarter, place, 2 AS page FROM (
          SELECT signal_id, report_id, report_quarter, row_number() OVER (PARTITION BY signal_id ORDER BY report_id) AS place
          FROM wide JOIN report_events USING (drug_name, event_name)) WHERE place BETWEEN 6 AND 10
        UNION ALL SELECT signal_id, report_id, report_quarter, place, 1 FROM (
          SELECT signal_id, report_id, report_quarter, row_number() OVER (PARTITION BY signal_id ORDER BY report_id) AS place
          FROM sig JOIN report_events USING (drug_name, event_name) WHERE dataset_version IS NULL OR dataset_version = report_quarter) WHERE place <= 50"""
    ),
    "list_releases": over(
        """SELECT report_quarter AS release_id, report_quarter AS quarter, 'FDA FAERS ' || report_quarter AS dataset_release,
        substr(report_quarter, 1, 4) || '-12-31' AS import_date, 'v1.0.0' AS processing_version, count(*) AS total_reports FROM cases GROUP BY 1"""
    ),
    "release_by_id": over(
        """SELECT report_quarter AS release_id, report_quarter AS quarter, 'FDA FAERS ' || report_quarter AS dataset_release,
        substr(report_quarter, 1, 4) || '-12-31' AS import_date, 'v1.0.0' AS processing_version, count(*) AS total_reports FROM cases
        WHERE report_quarter IN ('1998Q1', '1992Q3') GROUP BY 1"""
    ),
    "get_report": over(
        f"""SELECT report_id, drug_name, reactions, {r6('patient_age')} AS patient_age, patient_sex, event_date, seriousness, seriousness_codes,
        report_quarter, source FROM reports WHERE report_id = (SELECT CAST(max(CAST(primaryid AS BIGINT)) AS VARCHAR) FROM cases)"""
    ),
    "export_sort": over(f"SELECT signal_id, drug_name, event_name, {r6('prr')} AS prr FROM cands"),
    "queue_metrics_join": over(
        f"""SELECT signal_id, drug_name, event_name, {r6("CASE WHEN candidate_status = 'closed' THEN 0.375::DOUBLE ELSE t.trend_score END")} AS trend_score,
        {r6('risk_score')} AS risk_score FROM sig LEFT JOIN trends t USING (signal_id)"""
    ),
    "detail_join": over(
        f"""SELECT signal_id, dataset_version, CASE WHEN dataset_version IS NOT NULL THEN 'FDA FAERS' END AS dataset_source,
        CASE WHEN dataset_version IS NOT NULL THEN 'v1.0.0' END AS processing_version, substr(dataset_version, 1, 4) || '-12-31' AS import_date,
        {r6("CASE WHEN candidate_status = 'closed' THEN m.chi_square END")} AS chi_square,
        {r6("CASE WHEN candidate_status = 'closed' THEN 0.375::DOUBLE END")} AS trend_score, '{DEFAULTS}' AS known_limitations
        FROM sig JOIN (SELECT signal_id, chi_square FROM metrics) m USING (signal_id)"""
    ),
    "duplicate_self_join": over(
        f"SELECT signal_id, {r6('age')} AS age, sex, date, report_id_a, block_size, report_id_b FROM dups"
    ),
    "duplicate_candidates": over(
        f"""SELECT candidate_id, signal_id, report_id_a, report_id_b, {TEXT} AS rationale, 'drug|event|age|sex|event_date' AS matched_fields,
        'potential_duplicate' AS status FROM dups JOIN wide USING (signal_id)"""
    ),
    "duplicate_groups": over(
        f"""SELECT signal_id, {r6('age')} AS age, sex, date, report_id, block_size FROM members JOIN blocks USING (signal_id, age, sex, date)"""
    ),
    "duplicate_groups_of_orders": over(
        f"""SELECT drug_name AS signal_id, {r6('patient_age')} AS age, patient_sex AS sex, event_date AS date, count(*) AS block_size,
        min(report_id) AS first_report FROM reports WHERE patient_age IS NOT NULL AND patient_sex IS NOT NULL AND event_date IS NOT NULL
        GROUP BY drug_name, patient_age, patient_sex, event_date HAVING count(*) > 1"""
    ),
    "duplicate_counts": over(
        "SELECT signal_id, CAST(sum(block_size * (block_size - 1) // 2) AS BIGINT) AS duplicate_count FROM blocks GROUP BY 1"
    ),
    "duplicate_precedence": over(
        """SELECT candidate_id, signal_id, CASE WHEN prr > 1.1 THEN 'confirmed' ELSE 'potential_duplicate' END AS status
        FROM dups JOIN wide USING (signal_id)"""
    ),
    "stored_candidates": over(
        """, early AS (SELECT * FROM members WHERE CAST(report_id AS BIGINT) % 5 <> 0),
        anchors AS (SELECT signal_id, age, sex, date, min(report_id) AS anchor FROM early GROUP BY ALL HAVING count(*) > 1),
        listed AS (
          SELECT e.signal_id, anchor AS a, report_id AS b, true AS of_first_run FROM early e JOIN anchors USING (signal_id, age, sex, date) WHERE report_id <> anchor
          UNION ALL SELECT m.signal_id, least(anchor, report_id), greatest(anchor, report_id), false FROM members m JOIN anchors USING (signal_id, age, sex, date)
            WHERE CAST(report_id AS BIGINT) % 5 = 0
          UNION ALL SELECT m.signal_id, first_report, m.report_id, false FROM members m JOIN blocks USING (signal_id, age, sex, date)
            LEFT JOIN anchors USING (signal_id, age, sex, date) WHERE anchor IS NULL AND m.report_id <> first_report)
        SELECT 'DUP-' || upper(substr(sha256(signal_id || '|' || a || '|' || b), 1, 12)) AS candidate_id, signal_id, a AS report_id_a, b AS report_id_b,
          of_first_run, 0::BIGINT AS added_again FROM listed"""
    ),
    "top3_duplicates": over(
        """SELECT signal_id, candidate_id, position FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY candidate_id) AS position FROM dups)
        WHERE position <= 3"""
    ),
    "documents_latest_analysis": over(
        """SELECT signal_id, document_id, filename, analysis_id, analysis_status, coalesce(sections, 0)::BIGINT AS relevant_section_count,
        gap AS potential_coverage_gap, true AS human_review_required FROM doc_analysis"""
    ),
    "doc_signal_check": over(
        "SELECT document_id, signal_id FROM docs WHERE signal_id NOT IN (SELECT signal_id FROM sig) AND (SELECT count(*) FROM sig) > 0"
    ),
    "review_join": over(
        f"""SELECT signal_id, CASE WHEN begun THEN 'REV-' || substr(signal_id, 5, 10) END AS review_id,
        CASE candidate_status WHEN 'closed' THEN 'reviewed' WHEN 'under_review' THEN 'in_review' ELSE 'not_started' END AS review_status,
        CASE WHEN begun THEN 'note' ELSE '' END AS reviewer_notes, CASE WHEN begun THEN {DONE} ELSE 0 END::BIGINT AS items_done
        FROM (SELECT *, candidate_status <> 'candidate' AS begun FROM sig)"""
    ),
    "save_review": over(
        """SELECT signal_id, CASE WHEN fresh THEN 'reviewed' WHEN candidate_status = 'closed' THEN 'reviewed' ELSE 'in_review' END AS review_status,
        CASE WHEN fresh THEN 'updated' ELSE 'note' END AS reviewer_notes, true AS has_id, candidate_status <> 'candidate' AS kept_creation_time
        FROM (SELECT *, dataset_version IS NULL AS fresh FROM sig) WHERE fresh OR candidate_status <> 'candidate'"""
    ),
    "evidence_bundle": over(
        f"""SELECT q.signal_id, candidate_status, {r6('prr')} AS prr, {r6('CASE WHEN prr >= 2.1 THEN m.chi_square END')} AS chi_square,
        supporting_report_count AS report_count, series AS trend, {r6('quality_score')} AS quality_score, quality_flags,
        coalesce(duplicate_count, 0) AS duplicate_count, coalesce(rules, '') AS rules, coalesce(areas, '') AS areas
        FROM sig s JOIN quality q USING (signal_id) JOIN (SELECT signal_id, chi_square FROM metrics) m USING (signal_id)
        LEFT JOIN sig_dup_counts USING (signal_id)
        LEFT JOIN (SELECT signal_id, string_agg(rule_id, '|' ORDER BY rule_id) AS rules, string_agg(CASE rule_id WHEN 'REG-001' THEN 'Product Label'
          WHEN 'REG-002' THEN 'PSUR / PBRER' WHEN 'REG-003' THEN 'Risk Management Plan (RMP)' WHEN 'REG-004' THEN 'Reference Safety Information (RSI)'
          ELSE 'Relevant CTD safety content' END, '|' ORDER BY rule_id) AS areas FROM matches GROUP BY 1) USING (signal_id)"""
    ),
    "investigation_summary": over(
        f"""SELECT signal_id, CASE candidate_status WHEN 'closed' THEN 'reviewed' WHEN 'under_review' THEN 'in_review' ELSE 'not_started' END AS review_status,
        CASE WHEN candidate_status <> 'candidate' THEN {DONE} ELSE 0 END::BIGINT AS items_done, CASE WHEN candidate_status = 'closed' THEN 'reason 2' END AS explanation,
        coalesce(docs_n, 0) AS document_count, coalesce(analysed, 0) AS analysed_document_count, coalesce(gaps, 0) AS coverage_gap_count,
        coalesce(duplicate_count, 0) AS duplicate_count, coalesce(m, 0) AS rule_matches
        FROM sig LEFT JOIN (SELECT signal_id, count(*) AS docs_n, count(analysis_id) AS analysed, count(gap) AS gaps FROM doc_analysis GROUP BY 1) USING (signal_id)
        LEFT JOIN sig_dup_counts USING (signal_id) LEFT JOIN (SELECT signal_id, count(*) AS m FROM matches GROUP BY 1) USING (signal_id)"""
    ),
    **{
        f"rule_reg_00{i}": facts(
            f"SELECT signal_id, rule_name, condition_matched, document_type, priority FROM fired WHERE rule_id = 'REG-00{i}'"
        )
        for i in range(1, 6)
    },
    "evaluate_rules": facts(
        """SELECT signal_id, coalesce(rules, '') AS rules, coalesce(areas, '') AS areas FROM facts LEFT JOIN (
        SELECT signal_id, string_agg(rule_id, '|' ORDER BY rule_id) AS rules, string_agg(document_type || '=' || priority, '|' ORDER BY rule_id) AS areas
        FROM fired GROUP BY 1) USING (signal_id)"""
    ),
    "rule_callables": facts(
        """SELECT signal_id, coalesce(areas, '') AS areas FROM facts LEFT JOIN (
        SELECT signal_id, string_agg(document_type || '=' || priority, '|' ORDER BY place) AS areas FROM (
          SELECT signal_id, document_type, CASE WHEN document_type LIKE 'Reference%' AND n >= 20 THEN 'high' ELSE priority END AS priority, rule_id AS place FROM fired
          UNION ALL SELECT signal_id, 'Reference Safety Information (RSI)', 'high', 'ZZZ' FROM facts WHERE n >= 20 AND status = 'closed')
        GROUP BY 1) USING (signal_id)"""
    ),
    "regulatory_impact": over(
        """SELECT signal_id, coalesce(m, '') AS matches FROM sig LEFT JOIN (
        SELECT signal_id, string_agg(rule_id || ': ' || condition, '|' ORDER BY rule_id) AS m FROM matches GROUP BY 1) USING (signal_id)"""
    ),
    "rule_catalog": over(
        f"""SELECT rule_id, rule_name, target_document_type, default_priority, coalesce(n, 0) AS matching_signals FROM {RULE_NAMES}
        LEFT JOIN (SELECT rule_id, count(*) AS n FROM matches GROUP BY 1) USING (rule_id)"""
    ),
    "explain_responses": over(
        """SELECT signal_id, CASE WHEN even THEN 'w' ELSE 'plain ' || drug_name END AS why_flagged,
        CASE WHEN even THEN 'Summary of spontaneous reports.' ELSE 'plain ' || drug_name END AS interpretation,
        CASE WHEN even THEN 0 ELSE 2 END::BIGINT AS limitations, CASE WHEN even THEN '' ELSE 'Review detailed case narratives.' END AS questions
        FROM (SELECT *, supporting_report_count % 2 = 0 AS even FROM sig)"""
    ),
    # --- tables and jobs ---------------------------------------------------------------
    "upsert_signals": over(
        f"""SELECT signal_id, CASE WHEN prr > 2.1 THEN 'under_review' ELSE candidate_status END AS candidate_status,
        CASE WHEN prr > 2.1 THEN 7 ELSE 0 END::BIGINT AS rank, 'kept' AS known_limitations, {r6('prr')} AS prr FROM sig"""
    ),
    "import_counters": over(
        "SELECT 3 * count(*) AS total, 2 * count(*) AS inserted_or_updated, count(*) AS skipped, count(*) AS errors FROM sig WHERE prr > 2.1"
    ),
    "metrics_rows": over(
        f"""SELECT signal_id, {r6('prr')} AS prr, {r6('ror')} AS ror, a AS report_count, d, {r6('chi_square')} AS chi_square
        FROM metrics WHERE signal_id IN (SELECT signal_id FROM sig)"""
    ),
    "import_enriched_signals": over(
        f"""SELECT signal_id, {r6('prr')} AS prr, {r6('ror')} AS ror, a AS report_count, d, {r6('chi_square')} AS chi_square
        FROM metrics WHERE signal_id IN (SELECT signal_id FROM sig)"""
    ),
    "upsert_reports": over(
        """SELECT report_id, drug_name, seriousness, report_quarter, CASE WHEN seriousness = 'Serious' THEN 'CORRECTED' ELSE source END AS source FROM reports"""
    ),
    "one_row_per_report": over("SELECT report_id, max(drug_name) AS drug_name FROM reports GROUP BY 1"),
    "replace_quarter_pairs": over(
        """SELECT drug_name, event_name, report_quarter AS quarter, count(*) * CASE WHEN report_quarter >= '1998Q1' THEN 1 ELSE 2 END AS count
        FROM pairs JOIN cases USING (primaryid) GROUP BY 1, 2, 3"""
    ),
    "ingest_quarter_idempotent": over(
        f"SELECT report_id, drug_name, reactions, {r6('patient_age')} AS patient_age, patient_sex, seriousness, true AS refused FROM ingested"
    ),
    "detection_run_of_quarters": over(
        f"""SELECT signal_id, a AS supporting_report_count, {r6('prr')} AS prr, '2026Q1' AS dataset_version, (
          SELECT string_agg(q || '=' || n, ';' ORDER BY q) FROM (SELECT ['2025Q3', '2025Q4', '2026Q1'][CAST(CAST(report_id AS BIGINT) % 3 + 1 AS INTEGER)] AS q, count(*) AS n
            FROM reports GROUP BY 1)) AS reports FROM cands"""
    ),
    "ingest_in_batches": over(
        f"""SELECT report_id, drug_name, reactions, {r6('patient_age')} AS patient_age, patient_sex, seriousness, true AS four_batches, true AS marked_once,
        count(*) OVER () AS marked_reports, true AS stopped_early, false AS complete_early FROM ingested"""
    ),
    "stream_newest_cases": over(
        """SELECT caseid, primaryid, caseversion, event_dt, ['2025Q3', '2025Q4', '2026Q1'][CAST(CAST(primaryid AS BIGINT) % 3 + 1 AS INTEGER)] AS report_quarter
        FROM demo QUALIFY row_number() OVER (PARTITION BY caseid ORDER BY caseversion DESC, CAST(primaryid AS BIGINT) DESC) = 1"""
    ),
    "stream_pair_counts": over("SELECT drug_name, event_name, a FROM counts"),
    "ingest_new_files": over(
        "SELECT drug_name, event_name, count(*) AS count FROM (SELECT drug_name, unnest(ordered) AS event_name FROM ingested) GROUP BY 1, 2"
    ),
    "release_metadata": over(
        "SELECT '2026Q1' AS release_id, 'FDA FAERS 2026Q1' AS dataset_release, 'v1.0.0' AS processing_version, count(*) AS total_reports FROM cases"
    ),
    "detection_run": over(
        f"""SELECT signal_id, drug_name, event_name, supporting_report_count, {r6('prr')} AS prr, {r6('ror')} AS ror, '2026Q1' AS dataset_version FROM cands"""
    ),
    "normalized_reports": over(
        f"""SELECT report_id, drug_name, reactions, {r6('patient_age')} AS patient_age, patient_sex, event_date, seriousness, seriousness_codes,
        report_quarter, source FROM reports"""
    ),
    "enrichment_run": over(
        f"""SELECT signal_id, {r6('r')} AS risk_score, {level('r')} AS priority_level,
        row_number() OVER (ORDER BY r DESC NULLS LAST, n DESC, drug_name, event_name) AS rank
        FROM (SELECT signal_id, drug_name, event_name, supporting_report_count AS n, {risk(n='supporting_report_count')} AS r FROM cands)"""
    ),
    "load_report_level": over(
        """SELECT drug_name, event_name, a AS count, (SELECT count(*) FROM reports) AS release_reports FROM counts"""
    ),
    "backfill_seriousness": over("SELECT report_id, drug_name, seriousness, seriousness_codes FROM ingested"),
    "ingest_faers": over(f"SELECT {INGEST_COLUMNS} FROM ingested"),
}
