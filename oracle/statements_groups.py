"""Statements for filters, joins, sets, aggregations, windows and statistics."""

from __future__ import annotations

from oracle.base import chi, level, over, prr, prr_bound, r6, risk, ror, ror_bound, trend

ROUNDED = ", ".join(f"{r6(c)} AS {c}" for c in ("prr", "prr_lower", "prr_upper", "chi_square", "ror", "ror_lower", "ror_upper"))
HALF = {x: f"({x} + 0.5::DOUBLE)" for x in "abcd"}
SIGNAL_COLUMNS = f"""signal_id, drug_name, event_name, supporting_report_count, {r6('prr')} AS prr, {r6('ror')} AS ror,
    {r6('trend_score')} AS trend_score, {r6('risk_score')} AS risk_score, priority_level, candidate_status, dataset_version"""
RANK = """row_number() OVER (PARTITION BY dataset_version ORDER BY risk_score DESC NULLS LAST, trend_score DESC NULLS LAST,
    supporting_report_count DESC, upper(drug_name), upper(event_name), signal_id)"""
INGEST_COLUMNS = f"""report_id, drug_name, reactions, {r6('patient_age')} AS patient_age, patient_sex, event_date, seriousness,
    seriousness_codes, report_quarter, source"""


def _relaxed() -> str:
    cells = "SELECT *, a + 0.5::DOUBLE AS ha, b + 0.5::DOUBLE AS hb, c + 0.5::DOUBLE AS hc, d + 0.5::DOUBLE AS hd FROM metrics"
    p = prr("ha", "hb", "hc", "hd")
    n = "(ha + hb + hc + hd)"
    diff = f"greatest(abs(ha * hd - hb * hc) - {n} / 2.0::DOUBLE, 0.0::DOUBLE)"
    x = f"{n} * ({diff} * {diff}) / ((ha + hb) * (hc + hd) * (ha + hc) * (hb + hd))"
    return f"""SELECT signal_id, a AS supporting_report_count, {r6('p')} AS prr, '2026Q1' AS dataset_version FROM (
        SELECT signal_id, a, {p} AS p, {x} AS x FROM ({cells})) WHERE a >= 2 AND p >= 1.2 AND x >= 1.0"""


SQL = {
    "filter_role": over("SELECT primaryid, role_cod, count(*) AS rows FROM drug WHERE role_cod = 'PS' GROUP BY 1, 2"),
    "exclude_deleted_cases": over("SELECT primaryid, caseid FROM cases WHERE caseid NOT IN (SELECT caseid FROM deleted)"),
    "deleted_case_stats": over(
        """SELECT (SELECT count(*) FROM deleted) AS deleted_ids_available, count(*) AS deleted_ids_matched_in_demo, count(*) AS rows_excluded
        FROM cases WHERE caseid IN (SELECT caseid FROM deleted)"""
    ),
    "restrict_to_cases": over(
        "SELECT primaryid, count(*) AS rows FROM outc WHERE primaryid IN (SELECT primaryid FROM cases) GROUP BY 1"
    ),
    "detect_threshold": over(
        f"""SELECT drug_name, event_name, a, {r6('prr')} AS prr, {r6('chi_square')} AS chi_square FROM metrics
        WHERE a >= 3 AND prr >= 2.0 AND chi_square >= 4.0"""
    ),
    "queue_filters": over(
        """SELECT signal_id, drug_name, event_name FROM sig WHERE contains(upper(drug_name), 'B') AND contains(upper(event_name), 'SUPPLIER')
        AND prr >= 2.05 AND candidate_status = 'candidate'"""
    ),
    "queue_search_ui": over(
        """SELECT signal_id, drug_name, event_name FROM sig WHERE (contains(lower(drug_name), 'ring') OR contains(lower(event_name), 'ring'))
        AND priority_level = 'low'"""
    ),
    "array_contains_event": over(
        """SELECT report_id, drug_name, list_contains(string_split(reactions, '|'), 'SUPPLIER#000000007') AS exact,
        list_contains(string_split(reactions, '|'), 'SUPPLIER#000000007') AS ignoring_case FROM reports"""
    ),
    "valid_import_record": over("SELECT signal_id, supporting_report_count % 4 = 0 AS importable FROM cands"),
    "usable_report": over("SELECT DISTINCT primaryid FROM ps WHERE primaryid IN (SELECT primaryid FROM rc)"),
    "status_open_count": over(
        "SELECT count(*) AS total, count(*) FILTER (candidate_status <> 'closed') AS open_signals FROM sig"
    ),
    "pair_expansion": over("SELECT primaryid, caseid, drug_name, event_name FROM pairs"),
    "margins_join": over("SELECT drug_name, event_name, a, n_drug, n_event, n_total FROM cells"),
    "orphan_accounting": over(
        """SELECT count(d) AS primaryids_in_ps_drugs, count(r) AS primaryids_in_reactions, count(*) FILTER (d IS NOT NULL AND r IS NOT NULL) AS matched_primaryids,
        count(*) FILTER (r IS NULL) AS orphan_ps_drugs_primaryids, count(*) FILTER (d IS NULL) AS orphan_reactions_primaryids
        FROM (SELECT DISTINCT primaryid AS d FROM ps) FULL JOIN (SELECT DISTINCT primaryid AS r FROM rc) ON d = r"""
    ),
    "case_lookup_join": over(
        f"""SELECT primaryid, drug_name, {r6('patient_age')} AS patient_age, patient_sex, event_date, report_quarter
        FROM (SELECT DISTINCT primaryid, drug_name FROM pairs) LEFT JOIN cases USING (primaryid)"""
    ),
    "seriousness_join": over(
        """SELECT primaryid, coalesce(seriousness, 'Unknown') AS seriousness, coalesce(seriousness_codes, '') AS seriousness_codes
        FROM cases LEFT JOIN classified USING (primaryid)"""
    ),
    "ingest_outer_join": over(f"SELECT {INGEST_COLUMNS} FROM ingested"),
    "enrich_join": over(
        f"""SELECT signal_id, {r6('r')} AS risk_score, {level('r')} AS priority_level FROM (SELECT signal_id, {risk(
            chi='x', prr_lower='pl', ror_lower='rl')} AS r FROM (
        SELECT *, CASE WHEN prr > 2.1 THEN chi_square END AS x, CASE WHEN prr > 2.1 THEN prr_lower END AS pl,
          CASE WHEN prr > 2.1 THEN ror_lower END AS rl FROM cands))"""
    ),
    "metrics_semi": over(f"SELECT signal_id, a, {r6('chi_square')} AS chi_square FROM cands"),
    "supporting_reports_join": over(
        """SELECT signal_id, report_id, report_quarter, seriousness FROM sig JOIN report_events USING (drug_name, event_name)
        WHERE dataset_version IS NULL OR dataset_version = report_quarter"""
    ),
    "distinct_rows": over("SELECT primaryid, caseid, drug_name FROM ps"),
    "distinct_pairs": over("SELECT primaryid, drug_name, event_name, raw_drug_name, raw_reaction FROM pairs"),
    "union_all": over("SELECT report_quarter, CAST(sum(n) AS BIGINT) AS reports FROM support_all GROUP BY 1"),
    "intersect_except": over(
        """SELECT primaryid, 'drug' AS side FROM (SELECT primaryid FROM ps EXCEPT SELECT primaryid FROM rc)
        UNION ALL SELECT primaryid, 'reaction' FROM (SELECT primaryid FROM rc EXCEPT SELECT primaryid FROM ps)"""
    ),
    "id_union": over("SELECT primaryid FROM demo UNION SELECT primaryid FROM drug"),
    "pair_counts": over("SELECT drug_name, event_name, a FROM counts"),
    "pair_counts_by_quarter": over(
        "SELECT drug_name, event_name, report_quarter AS quarter, count(*) AS count FROM pairs JOIN cases USING (primaryid) GROUP BY 1, 2, 3"
    ),
    "contingency_table": over("SELECT drug_name, event_name, a, n_drug, n_event, n_total, b, c, d FROM cells"),
    "reactions_per_report": over("SELECT primaryid, reactions FROM reaction_lists"),
    "reactions_in_order": over(
        """SELECT primaryid, array_to_string(list(event_name ORDER BY line, first_pt), '|') AS reactions FROM (
        SELECT primaryid, upper(trim(pt)) AS event_name, min(l_linenumber) AS line, arg_min(pt, (l_linenumber, pt)) AS first_pt
        FROM reac GROUP BY 1, 2) GROUP BY 1"""
    ),
    "seriousness": over("SELECT primaryid, seriousness, seriousness_codes FROM classified"),
    "seriousness_ingest": over("SELECT primaryid, seriousness, seriousness_codes FROM classified_ingest"),
    "primary_drug": over("SELECT report_id AS primaryid, drug_name FROM (SELECT primaryid AS report_id, upper(trim(drugname)) AS drug_name FROM drug QUALIFY row_number() OVER (PARTITION BY primaryid ORDER BY role_cod <> 'PS', CAST(drug_seq AS INTEGER), drugname) = 1)"),
    "first_demo_per_report": over(
        """SELECT caseid AS primaryid, trim(age) AS age, trim(age_cod) AS age_cod, trim(sex) AS sex, trim(event_dt) AS event_dt FROM demo
        QUALIFY row_number() OVER (PARTITION BY caseid ORDER BY caseversion, CAST(primaryid AS BIGINT)) = 1"""
    ),
    "pair_stats": over(
        """SELECT 'ps_drug_rows_before_norm' AS stat, count(*) AS value FROM drug WHERE role_cod = 'PS'
        UNION ALL SELECT 'unique_ps_drugs_after_norm', count(DISTINCT drug_name) FROM ps
        UNION ALL SELECT 'normalized_drug_names_missing', 0 UNION ALL SELECT 'reactions_before_norm', count(*) FROM reac
        UNION ALL SELECT 'unique_reactions_after_norm', count(DISTINCT event_name) FROM rc UNION ALL SELECT 'normalized_reactions_missing', 0
        UNION ALL SELECT 'primaryids_in_ps_drugs', count(DISTINCT primaryid) FROM ps
        UNION ALL SELECT 'primaryids_in_reactions', count(DISTINCT primaryid) FROM rc
        UNION ALL SELECT 'matched_primaryids', count(DISTINCT primaryid) FROM ps WHERE primaryid IN (SELECT primaryid FROM rc)
        UNION ALL SELECT 'orphan_ps_drugs_primaryids', count(DISTINCT primaryid) FROM ps WHERE primaryid NOT IN (SELECT primaryid FROM rc)
        UNION ALL SELECT 'orphan_reactions_primaryids', count(DISTINCT primaryid) FROM rc WHERE primaryid NOT IN (SELECT primaryid FROM ps)
        UNION ALL SELECT 'unique_pairs', count(*) FROM pairs UNION ALL SELECT 'pairs_with_missing_drug_name', 0
        UNION ALL SELECT 'pairs_with_missing_reaction', 0"""
    ),
    "detection_stats": over(
        """SELECT count(*) AS total_pairs_evaluated, (SELECT count(*) FROM cands) AS pairs_above_thresholds, count(prr) AS finite_prr_pairs,
        count(chi_square) AS finite_chi2_pairs, count(ror) AS finite_ror_pairs, (SELECT count(*) FROM cands) AS candidates_detected FROM metrics"""
    ),
    "trend_series": over("SELECT signal_id, series FROM quality"),
    "trend_slope": over("SELECT signal_id, trend_score FROM trends"),
    "trend_slope_of_users": f"""
        SELECT user_id, {trend('n', 'x')} AS trend_score FROM (
        SELECT user_id, n, row_number() OVER (PARTITION BY user_id ORDER BY d) - 1 AS x FROM (
          SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2)) GROUP BY 1""",
    "case_quality": over(
        f"""SELECT signal_id, total_reports, missing_age_count, missing_sex_count, missing_date_count, {r6('quality_score')} AS quality_score,
        quality_flags, indicators FROM quality"""
    ),
    "case_quality_precedence": over(
        f"""SELECT signal_id, CASE WHEN candidate_status = 'closed' THEN 1 ELSE total_reports END AS total_reports,
        {r6("CASE WHEN candidate_status = 'closed' THEN 0.5::DOUBLE ELSE quality_score END")} AS quality_score,
        CASE WHEN candidate_status = 'closed' THEN 'stored' ELSE quality_flags END AS quality_flags FROM sig JOIN quality USING (signal_id)"""
    ),
    "name_search": over(
        """, texts AS (SELECT unnest(['b', 'ri', 'ing', ' Small Gizm', 'R#00000000', 'no such name', 'd w', '']) AS text)
        SELECT DISTINCT text, drug_name AS name, 'drug' AS kind FROM texts, pairs WHERE contains(drug_name, upper(trim(text)))
        UNION ALL SELECT DISTINCT text, event_name, 'event' FROM texts, pairs WHERE contains(event_name, upper(trim(text)))
        UNION ALL SELECT DISTINCT text, drug_name, 'drug of 1998Q1' FROM texts, pairs JOIN cases USING (primaryid)
          WHERE report_quarter = '1998Q1' AND contains(drug_name, upper(trim(text)))"""
    ),
    "drug_search_by_index": over(
        """, texts AS (SELECT unnest(['b', 'ri', 'ing', ' Small Gizm', 'R#00000000', 'no such name', 'd w', '']) AS text),
        hits AS (SELECT text, drug_name, count(*) AS n FROM texts, sig WHERE contains(upper(drug_name), upper(trim(text))) GROUP BY 1, 2)
        SELECT text, drug_name, n AS candidate_signals_count FROM hits
        UNION ALL SELECT DISTINCT text, drug_name, 0 FROM texts, pairs WHERE contains(drug_name, upper(trim(text))) AND text NOT IN (SELECT text FROM hits)"""
    ),
    "queue_filters_by_index": over(
        "SELECT signal_id, drug_name, event_name, a FROM metrics WHERE contains(drug_name, 'ED G') AND contains(event_name, '#00000001')"
    ),
    "drug_search": over(
        """SELECT drug_name, candidate_signals_count FROM (
        SELECT drug_name, count(*) AS candidate_signals_count FROM sig WHERE contains(upper(drug_name), 'B') GROUP BY 1
        UNION ALL SELECT DISTINCT drug_name, 0 FROM reports WHERE contains(drug_name, 'B')
          AND NOT EXISTS (SELECT 1 FROM sig WHERE contains(upper(drug_name), 'B')))
        ORDER BY candidate_signals_count DESC, drug_name"""
    ),
    "drug_search_reports_only": over(
        "SELECT DISTINCT drug_name, 0::BIGINT AS candidate_signals_count FROM reports WHERE contains(drug_name, 'BOLT') ORDER BY 1"
    ),
    "group_by_drug": over("SELECT drug_name, signal_id, count(*) OVER (PARTITION BY drug_name) AS cluster_size FROM cands"),
    "group_by_event": over("SELECT event_name, signal_id, count(*) OVER (PARTITION BY event_name) AS cluster_size FROM cands"),
    "enrichment_summary": over(
        """SELECT count(*) AS total, count(risk_score) AS with_risk_score, count(trend_score) AS with_trend_score,
        count(*) FILTER (priority_level = 'critical') AS priority_critical, count(*) FILTER (priority_level = 'high') AS priority_high,
        count(*) FILTER (priority_level = 'medium') AS priority_medium, count(*) FILTER (priority_level = 'low') AS priority_low,
        count(*) FILTER (priority_level IS NULL) AS priority_none FROM sig"""
    ),
    "backfill_update_join": over(
        """SELECT report_id, drug_name, coalesce(c.seriousness, 'Unknown') AS seriousness, coalesce(c.seriousness_codes, '') AS seriousness_codes,
        c.seriousness IS NOT NULL AS changed FROM reports r LEFT JOIN classified_ingest c ON c.primaryid = r.report_id"""
    ),
    "backfill_summary": over(
        """SELECT count(*) AS reports_scoped, count(c.seriousness) AS reports_updated, count(*) FILTER (c.seriousness = 'Serious') AS serious,
        count(*) FILTER (c.seriousness = 'Non-serious') AS non_serious, count(*) FILTER (c.seriousness IS NULL) AS unknown
        FROM reports r LEFT JOIN classified_ingest c ON c.primaryid = r.report_id"""
    ),
    "case_version_stats": over(
        """SELECT count(*) AS total_input_rows, count(DISTINCT caseid) AS unique_caseids_before, count(DISTINCT caseid) AS unique_caseids_after,
        count(DISTINCT caseid) AS rows_retained, count(*) - count(DISTINCT caseid) AS rows_excluded, 'latest' AS case_version_policy FROM demo"""
    ),
    "checklist_progress": over(
        """SELECT report_id, drug_name, CAST((patient_age IS NOT NULL)::INT + (patient_sex IS NOT NULL)::INT + (event_date IS NOT NULL)::INT
        + (seriousness = 'Serious')::INT + (n_reactions > 2)::INT AS BIGINT) AS items_done FROM reports"""
    ),
    "latest_case_version": over("SELECT caseid, primaryid, caseversion FROM cases"),
    "rank_signals": over(f"SELECT signal_id, dataset_version, {r6('risk_score')} AS risk_score, {RANK} AS rank FROM sig"),
    "rank_pairs": over(
        """SELECT signal_id, drug_name AS dataset_version, row_number() OVER (PARTITION BY drug_name ORDER BY round(prr, 6) DESC NULLS LAST, a DESC,
        event_name, signal_id) AS rank FROM metrics"""
    ),
    "margins": over(
        """SELECT 'drug' AS side, drug_name AS name, max(n_drug) AS reports, CAST(sum(a) AS BIGINT) AS sum_of_cells FROM cells GROUP BY 1, 2
        UNION ALL SELECT 'event', event_name, max(n_event), CAST(sum(a) AS BIGINT) FROM cells GROUP BY 1, 2"""
    ),
    "latest_per_key": """
        SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1""",
    # --- statistics -------------------------------------------------------------
    "prr": over(f"SELECT drug_name, event_name, {r6('prr')} AS prr, {r6(prr(*HALF.values()))} AS prr_corrected FROM metrics"),
    "prr_ci": over(f"SELECT drug_name, event_name, {r6('prr_lower')} AS prr_lower, {r6('prr_upper')} AS prr_upper FROM metrics"),
    "chi_square": over(
        f"SELECT drug_name, event_name, {r6('chi_square')} AS chi_square, {r6(chi(yates=True))} AS chi_square_yates FROM metrics"
    ),
    "ror": over(f"SELECT drug_name, event_name, {r6('ror')} AS ror FROM metrics"),
    "ror_ci": over(f"SELECT drug_name, event_name, {r6('ror_lower')} AS ror_lower, {r6('ror_upper')} AS ror_upper FROM metrics"),
    "degenerate_cells": f"""
        WITH t AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 250000) AS a,
          count(*) FILTER (o_orderstatus = 'F' AND o_totalprice <= 250000) AS b, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 250000) AS c,
          count(*) FILTER (o_orderstatus = 'O' AND o_totalprice <= 250000) AS d FROM orders GROUP BY 1)
        SELECT o_custkey, a, b, c, d, {r6(prr())} AS prr, {r6(prr_bound('-'))} AS prr_lower, {r6(prr_bound('+'))} AS prr_upper,
          {r6(chi())} AS chi_square, {r6(ror())} AS ror, {r6(ror_bound('-'))} AS ror_lower, {r6(ror_bound('+'))} AS ror_upper FROM t""",
    "disproportionality": over(
        f"SELECT drug_name, event_name, a, n_drug, n_event, n_total, b, c, d, signal_id, {ROUNDED} FROM metrics"
    ),
    "detect_signals": over(
        f"SELECT signal_id, drug_name, event_name, supporting_report_count, {r6('prr')} AS prr, {r6('ror')} AS ror, 'candidate' AS candidate_status FROM cands"
    ),
    "detect_signals_relaxed": over(_relaxed()),
    "candidate_signals_export": over(
        f"""SELECT signal_id, drug_name, event_name, supporting_report_count, {r6('prr')} AS prr, {r6('ror')} AS ror, NULL::DOUBLE AS trend_score,
        NULL::DOUBLE AS risk_score, NULL::VARCHAR AS priority_level, candidate_status, dataset_version FROM sig"""
    ),
    "risk_score": over(f"SELECT signal_id, {r6(risk())} AS risk_score FROM metrics"),
    "priority": over(f"SELECT {level('r')} AS priority_level, count(*) AS pairs FROM (SELECT {risk()} * 10 AS r FROM metrics) GROUP BY 1"),
    "enrich_signals": over(f"SELECT {SIGNAL_COLUMNS} FROM sig"),
    "ranked_signals": over(f"SELECT {SIGNAL_COLUMNS}, {RANK} AS rank FROM sig"),
    "feature_cluster": over(
        f"""SELECT signal_id, {r6("(p - min(p) OVER ()) / (max(p) OVER () - min(p) OVER ())")} AS s_prr,
        {r6("(r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ())")} AS s_ror,
        {r6("(n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ())")} AS s_count, 0.0::DOUBLE AS s_risk, true AS is_nearest
        FROM (SELECT signal_id, coalesce(prr, 0) AS p, coalesce(nullif(ror, 0), prr, 0) AS r, ln(1 + a::DOUBLE) AS n FROM metrics)"""
    ),
    "cluster_centroids": over(
        """SELECT count(*) AS members, greatest(2, least(8, CAST(floor(sqrt(count(*) / 2)) AS BIGINT))) AS clusters, true AS means_of_members FROM metrics"""
    ),
    "cluster_features": over(
        f"""SELECT signal_id, {r6('prr')} AS f_prr, {r6('coalesce(ror, prr)')} AS f_ror, {r6('ln(1 + supporting_report_count::DOUBLE)')} AS f_count,
        {r6('coalesce(risk_score, 0)')} AS f_risk FROM sig"""
    ),
    "cluster_signals": over(
        """SELECT 'drug' AS kind, drug_name AS name, count(*) AS cluster_size FROM cands GROUP BY 1, 2
        UNION ALL SELECT 'event', event_name, count(*) FROM cands GROUP BY 1, 2"""
    ),
}
