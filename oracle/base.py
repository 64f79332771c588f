"""Common table expressions shared by the statements."""

from __future__ import annotations


def r6(x: str) -> str:
    """Six decimals, ties to even."""
    return f"(round_even(({x}) * 1000000.0::DOUBLE, 0) / 1000000.0::DOUBLE)"


def r2(x: str) -> str:
    return f"(round_even(({x}) * 100.0::DOUBLE, 0) / 100.0::DOUBLE)"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace(upper({x}), '\s+', ' ', 'g'))"


def drug_name(x: str) -> str:
    return rf"nullif(regexp_replace({squeeze(x)}, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g'), '')"


def event_name(x: str) -> str:
    return f"nullif({squeeze(x)}, '')"


def event_date(x: str) -> str:
    return (
        rf"CASE WHEN regexp_full_match(trim({x}), '\d{{8}}') "
        f"THEN strftime(try_strptime(trim({x}), '%Y%m%d'), '%Y-%m-%d') END"
    )


def age_years(age: str, unit: str) -> str:
    return r2(
        f"TRY_CAST(nullif(trim({age}), '') AS DOUBLE) / CASE upper(trim({unit})) WHEN 'YR' THEN 1.0::DOUBLE "
        "WHEN 'MON' THEN 12.0::DOUBLE WHEN 'WK' THEN 52.0::DOUBLE WHEN 'DY' THEN 365.25::DOUBLE "
        "WHEN 'HR' THEN 8766.0::DOUBLE WHEN 'DEC' THEN 1.0::DOUBLE END"
    )


def sex(x: str) -> str:
    return f"CASE WHEN upper(trim({x})) IN ('F', 'M') THEN upper(trim({x})) END"


def signal_id(drug: str, event: str) -> str:
    return f"'SIG-' || upper(substr(sha256({drug} || chr(31) || {event}), 1, 10))"


def prr(a="a", b="b", c="c", d="d") -> str:
    return (
        f"CASE WHEN {a} + {b} > 0 AND {c} > 0 THEN "
        f"(({a})::DOUBLE / ({a} + {b})::DOUBLE) / (({c})::DOUBLE / ({c} + {d})::DOUBLE) END"
    )


def ror(a="a", b="b", c="c", d="d") -> str:
    return (
        f"CASE WHEN ({b})::DOUBLE * ({c})::DOUBLE > 0 THEN "
        f"(({a})::DOUBLE * ({d})::DOUBLE) / (({b})::DOUBLE * ({c})::DOUBLE) END"
    )


def prr_bound(sign: str) -> str:
    return (
        f"CASE WHEN a > 0 AND c > 0 THEN exp(ln({prr()}) {sign} 1.96::DOUBLE * sqrt(1.0::DOUBLE / a - 1.0::DOUBLE / (a + b) "
        "+ 1.0::DOUBLE / c - 1.0::DOUBLE / (c + d))) END"
    )


def ror_bound(sign: str) -> str:
    zero = "WHEN d = 0 AND b * c > 0 THEN 0.0::DOUBLE " if sign == "-" else ""
    return (
        f"CASE {zero}WHEN a > 0 AND b > 0 AND c > 0 AND d > 0 THEN exp(ln({ror()}) {sign} 1.96::DOUBLE * "
        "sqrt(1.0::DOUBLE / a + 1.0::DOUBLE / b + 1.0::DOUBLE / c + 1.0::DOUBLE / d)) END"
    )


def chi(yates: bool = False) -> str:
    a, b, c, d = (f"{x}::DOUBLE" for x in "abcd")
    diff = f"({a} * {d} - {b} * {c})"
    n = f"({a} + {b} + {c} + {d})"
    if yates:
        diff = f"greatest(abs({diff}) - {n} / 2.0::DOUBLE, 0.0::DOUBLE)"
    den = f"(({a} + {b}) * ({c} + {d}) * ({a} + {c}) * ({b} + {d}))"
    return f"CASE WHEN {den} > 0 THEN {n} * ({diff} * {diff}) / {den} END"


def risk(prr="prr", ror="ror", n="a", chi="chi_square", prr_lower="prr_lower", ror_lower="ror_lower") -> str:
    def ratio(x: str, low: str) -> str:
        v = f"coalesce({low}, {x})"
        return f"CASE WHEN {v} >= 1 THEN least({v}, 20.0::DOUBLE) / 20.0::DOUBLE ELSE 0.0::DOUBLE END"

    score = (
        f"0.40::DOUBLE * {ratio(prr, prr_lower)} + 0.25::DOUBLE * (least(ln(1 + {n}::DOUBLE), 7.0::DOUBLE) / 7.0::DOUBLE) "
        f"+ 0.20::DOUBLE * CASE WHEN {chi} IS NOT NULL THEN least({chi}, 100.0::DOUBLE) / 100.0::DOUBLE ELSE 0.0::DOUBLE END + 0.15::DOUBLE * {ratio(ror, ror_lower)}"
    )
    clamped = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {score}))"
    return f"CASE WHEN ({prr} IS NOT NULL OR {ror} IS NOT NULL) AND {n} >= 1 THEN {r6(clamped)} END"


def level(x: str) -> str:
    return (
        f"CASE WHEN {x} >= 0.75 THEN 'critical' WHEN {x} >= 0.5 THEN 'high' "
        f"WHEN {x} >= 0.25 THEN 'medium' WHEN {x} IS NOT NULL THEN 'low' END"
    )


def trend(y: str, x: str) -> str:
    """Slope over mean of an aggregate over at least two points."""
    body = f"greatest(-1.0::DOUBLE, least(1.0::DOUBLE, regr_slope({y}, {x}) / avg({y})))"
    return f"CASE WHEN count(*) >= 2 AND avg({y}) > 0 THEN {r6(body)} END"


def two(x: str) -> str:
    return f"printf('%.2f', {x})"


CTE = f"""
demo AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS primaryid,
    CAST(o_custkey AS VARCHAR) || '-' || CAST(year(o_orderdate) AS VARCHAR) AS caseid,
    CAST(o_orderkey % 5 + 1 AS VARCHAR) AS caseversion,
    CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CAST(year(o_orderdate) AS VARCHAR)
      || CASE WHEN month(o_orderdate) <= 6 THEN '0101' ELSE '0701' END END AS event_dt,
    CASE WHEN o_orderkey % 7 = 0 THEN ''
      ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 10 * 10 AS VARCHAR) END AS age,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'YR' WHEN '2' THEN 'MON' WHEN '3' THEN 'WK'
      WHEN '4' THEN 'DY' ELSE '' END AS age_cod,
    CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'm ' ELSE 'U' END AS sex,
    CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS report_quarter
  FROM orders),
drug AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS primaryid, CAST(l_orderkey AS VARCHAR) AS caseid,
    CAST(l_linenumber AS VARCHAR) AS drug_seq,
    CASE WHEN l_linenumber <= 2 THEN 'PS' WHEN l_linenumber <= 4 THEN 'SS' ELSE 'C' END AS role_cod,
    CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN '  ' || upper(p_name) || '.'
      ELSE replace(p_name, ' ', '  ') || ', ' END AS drugname
  FROM lineitem JOIN part ON l_partkey = p_partkey),
reac AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS primaryid, CAST(l_orderkey AS VARCHAR) AS caseid,
    CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE ' ' || lower(s_name) || '  ' END AS pt, l_linenumber
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
outc AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS primaryid, CAST(l_orderkey AS VARCHAR) AS caseid,
    CASE WHEN l_returnflag = 'A' THEN 'DE' WHEN l_returnflag = 'R' AND l_linenumber > 3 THEN 'ho '
      WHEN l_returnflag = 'R' THEN '' ELSE 'ZZ' END AS outc_cod
  FROM lineitem WHERE l_linenumber <= 4 OR l_returnflag = 'R'),
deleted AS (
  SELECT DISTINCT CAST(o_custkey AS VARCHAR) || '-' || CAST(year(o_orderdate) AS VARCHAR) AS caseid
  FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)),
typed AS (
  SELECT primaryid, caseid, caseversion, primaryid AS report_id, {event_date('event_dt')} AS event_date,
    {age_years('age', 'age_cod')} AS patient_age, {sex('sex')} AS patient_sex, report_quarter,
    'FDA_FAERS' AS source
  FROM demo),
cases AS (
  SELECT * FROM typed QUALIFY row_number() OVER
    (PARTITION BY caseid ORDER BY caseversion DESC, CAST(primaryid AS BIGINT) DESC) = 1),
ps AS (
  SELECT primaryid, caseid, {drug_name('drugname')} AS drug_name, min(drugname) AS raw_drug_name
  FROM drug WHERE role_cod = 'PS' AND {drug_name('drugname')} IS NOT NULL
    AND primaryid IN (SELECT primaryid FROM cases) GROUP BY 1, 2, 3),
rc AS (
  SELECT primaryid, caseid, {event_name('pt')} AS event_name, min(pt) AS raw_reaction
  FROM reac WHERE {event_name('pt')} IS NOT NULL
    AND primaryid IN (SELECT primaryid FROM cases) GROUP BY 1, 2, 3),
pairs AS (
  SELECT primaryid, min(caseid) AS caseid, drug_name, event_name, min(raw_drug_name) AS raw_drug_name,
    min(raw_reaction) AS raw_reaction
  FROM ps JOIN rc USING (primaryid, caseid) GROUP BY primaryid, drug_name, event_name),
counts AS (SELECT drug_name, event_name, count(*) AS a FROM pairs GROUP BY 1, 2),
cells AS (
  SELECT drug_name, event_name, a, n_drug, n_event, n_total, n_drug - a AS b, n_event - a AS c,
    n_total - n_drug - n_event + a AS d
  FROM (SELECT *, CAST(sum(a) OVER (PARTITION BY drug_name) AS BIGINT) AS n_drug,
      CAST(sum(a) OVER (PARTITION BY event_name) AS BIGINT) AS n_event,
      CAST(sum(a) OVER () AS BIGINT) AS n_total FROM counts)),
metrics AS (
  SELECT *, {signal_id('drug_name', 'event_name')} AS signal_id, {prr()} AS prr,
    {prr_bound('-')} AS prr_lower, {prr_bound('+')} AS prr_upper, {chi()} AS chi_square, {ror()} AS ror,
    {ror_bound('-')} AS ror_lower, {ror_bound('+')} AS ror_upper
  FROM cells),
cands AS (
  SELECT signal_id, drug_name, event_name, a AS supporting_report_count, prr, ror, chi_square, prr_lower,
    ror_lower, a
  FROM metrics WHERE a >= 3 AND prr >= 2.0 AND chi_square >= 4.0),
classes AS (
  SELECT primaryid, list_sort(list(DISTINCT code) FILTER (code IN ('DE','LT','HO','DS','CA','RI','OT'))) AS codes
  FROM (SELECT primaryid, upper(trim(outc_cod)) AS code FROM outc) GROUP BY 1),
classified AS (
  SELECT primaryid, CASE WHEN len(coalesce(codes, [])) > 0 THEN 'Serious' ELSE 'Non-serious' END AS seriousness,
    coalesce(array_to_string(codes, '|'), '') AS seriousness_codes FROM classes),
classified_ingest AS (
  SELECT primaryid, CASE WHEN len(coalesce(codes, [])) > 0 THEN 'Serious' ELSE 'Non-serious' END AS seriousness,
    coalesce(array_to_string(codes, '|'), '') AS seriousness_codes FROM (
    SELECT primaryid, list_sort(list(DISTINCT code) FILTER (code IN ('DE','LT','HO','DS','CA','RI','OT'))) AS codes
    FROM (SELECT primaryid, upper(trim(outc_cod)) AS code FROM outc) WHERE code <> '' GROUP BY 1)),
reaction_lists AS (
  SELECT primaryid, array_to_string(list_sort(list(DISTINCT event_name)), '|') AS reactions,
    len(list(DISTINCT event_name)) AS n_reactions FROM pairs GROUP BY 1),
reports AS (
  SELECT p.primaryid AS report_id, drug_name, reactions, n_reactions, patient_age, patient_sex, event_date,
    coalesce(seriousness, 'Unknown') AS seriousness, coalesce(seriousness_codes, '') AS seriousness_codes,
    report_quarter, 'FDA_FAERS' AS source
  FROM (SELECT DISTINCT primaryid, drug_name FROM pairs) p JOIN reaction_lists USING (primaryid)
    LEFT JOIN cases USING (primaryid) LEFT JOIN classified USING (primaryid)),
report_events AS (
  SELECT r.*, p.event_name FROM reports r
    JOIN (SELECT DISTINCT primaryid, event_name FROM pairs) p ON p.primaryid = r.report_id),
support_all AS (
  SELECT signal_id, report_quarter, count(*) AS n, count(*) FILTER (patient_age IS NULL) AS no_age,
    count(*) FILTER (patient_sex IS NULL) AS no_sex, count(*) FILTER (event_date IS NULL) AS no_date
  FROM cands JOIN report_events USING (drug_name, event_name) GROUP BY 1, 2),
trends AS (
  SELECT signal_id, {trend('n', 'x')} AS trend_score, max(report_quarter) AS newest FROM (
    SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY report_quarter) - 1 AS x FROM support_all)
  GROUP BY 1),
scored AS (
  SELECT cands.*, trend_score, newest, {risk()} AS risk_score FROM cands LEFT JOIN trends USING (signal_id)),
sig AS (
  SELECT signal_id, drug_name, event_name, supporting_report_count, prr, ror, trend_score, risk_score,
    {level('risk_score')} AS priority_level,
    CASE supporting_report_count % 5 WHEN 0 THEN 'closed' WHEN 1 THEN 'under_review' ELSE 'candidate' END AS candidate_status,
    CASE WHEN supporting_report_count % 2 = 0 THEN newest END AS dataset_version
  FROM scored),
support AS (
  SELECT s.* FROM support_all s JOIN sig USING (signal_id)
  WHERE dataset_version IS NULL OR dataset_version = report_quarter),
support_sum AS (
  SELECT signal_id, CAST(sum(n) AS BIGINT) AS matched, CAST(sum(no_age) AS BIGINT) AS no_age,
    CAST(sum(no_sex) AS BIGINT) AS no_sex, CAST(sum(no_date) AS BIGINT) AS no_date,
    string_agg(report_quarter || '=' || CAST(n AS VARCHAR), ';' ORDER BY report_quarter) AS series,
    '[' || string_agg('{{''quarter'': ''' || report_quarter || ''', ''count'': ' || CAST(n AS VARCHAR) || '}}', ', ' ORDER BY report_quarter) || ']' AS series_text
  FROM support GROUP BY 1),
quality0 AS (
  SELECT sig.signal_id, coalesce(matched, supporting_report_count) AS total_reports,
    coalesce(no_age, 0) AS missing_age_count, coalesce(no_sex, 0) AS missing_sex_count,
    coalesce(no_date, 0) AS missing_date_count, coalesce(series, '') AS series, series_text
  FROM sig LEFT JOIN support_sum USING (signal_id)),
quality1 AS (
  SELECT *, missing_age_count::DOUBLE / total_reports AS age_p, missing_sex_count::DOUBLE / total_reports AS sex_p,
    missing_date_count::DOUBLE / total_reports AS date_p FROM quality0),
quality AS (
  SELECT *, greatest(0.0::DOUBLE, {r2('1.0::DOUBLE - (age_p * 0.3::DOUBLE + sex_p * 0.3::DOUBLE + date_p * 0.4::DOUBLE)')}) AS quality_score,
    concat_ws('|', CASE WHEN age_p > 0.3 THEN 'high_missing_age' WHEN age_p > 0 THEN 'minor_missing_age' END,
      CASE WHEN sex_p > 0.3 THEN 'high_missing_sex' END, CASE WHEN date_p > 0.3 THEN 'high_missing_date' END) AS quality_flags,
    concat_ws('|',
      CASE WHEN age_p > 0.3 THEN CAST(CAST(floor(age_p * 100) AS BIGINT) AS VARCHAR) || '% of reports are missing patient age. [high]'
        WHEN age_p > 0 THEN CAST(CAST(floor(age_p * 100) AS BIGINT) AS VARCHAR) || '% of reports are missing patient age. [low]' END,
      CASE WHEN sex_p > 0.3 THEN CAST(CAST(floor(sex_p * 100) AS BIGINT) AS VARCHAR) || '% of reports are missing patient sex. [medium]' END,
      CASE WHEN date_p > 0.3 THEN CAST(CAST(floor(date_p * 100) AS BIGINT) AS VARCHAR) || '% of reports are missing event onset date. [high]' END) AS indicators
  FROM quality1),
matches AS (
  SELECT signal_id, rule_id, condition FROM (
    SELECT signal_id, 'REG-001' AS rule_id, 'PRR=' || {two('prr')} || ' (>= 2.5) with ' || supporting_report_count || ' supporting reports (>= 10).' AS condition
      FROM sig WHERE prr >= 2.5 AND supporting_report_count >= 10
    UNION ALL SELECT signal_id, 'REG-002', 'Trend Score=' || {two('trend_score')} || ' (>= 0.50).' FROM sig WHERE trend_score >= 0.5
    UNION ALL SELECT signal_id, 'REG-003', concat_ws(' and ',
        CASE WHEN priority_level IN ('high', 'critical') THEN 'Priority Level=''' || priority_level || '''' END,
        CASE WHEN risk_score >= 0.7 THEN 'Risk Score=' || {two('risk_score')} || ' (>= 0.70)' END)
      FROM sig WHERE priority_level IN ('high', 'critical') OR risk_score >= 0.7
    UNION ALL SELECT signal_id, 'REG-004', 'Active status=''' || candidate_status || ''' with ' || supporting_report_count || ' reports (>= 5).'
      FROM sig WHERE supporting_report_count >= 5 AND candidate_status IN ('candidate', 'under_review')
    UNION ALL SELECT signal_id, 'REG-005', CASE WHEN quality_score < 0.8 THEN 'Quality Score=' || CAST(quality_score AS VARCHAR) || ' (< 0.80)'
        ELSE 'Quality Flags=[''' || replace(quality_flags, '|', ''', ''') || ''']' END
      FROM quality WHERE quality_score < 0.8 OR quality_flags LIKE '%high_missing%')),
wide AS (
  SELECT signal_id, drug_name, event_name, a AS supporting_report_count, prr, ror FROM metrics),
members AS (
  SELECT DISTINCT signal_id, patient_age AS age, patient_sex AS sex, event_date AS date, report_id
  FROM wide JOIN report_events USING (drug_name, event_name)
  WHERE patient_age IS NOT NULL AND patient_sex IS NOT NULL AND event_date IS NOT NULL),
blocks AS (
  SELECT signal_id, age, sex, date, count(*) AS block_size, min(report_id) AS first_report
  FROM members GROUP BY 1, 2, 3, 4 HAVING count(*) > 1),
dups AS (
  SELECT m.signal_id, m.age, m.sex, m.date, first_report AS report_id_a, m.report_id AS report_id_b, block_size,
    'DUP-' || upper(substr(sha256(m.signal_id || '|' || first_report || '|' || m.report_id), 1, 12)) AS candidate_id
  FROM members m JOIN blocks b USING (signal_id, age, sex, date) WHERE m.report_id <> first_report),
sig_members AS (
  SELECT DISTINCT m.* FROM members m JOIN sig USING (signal_id)
  JOIN reports r ON r.report_id = m.report_id AND r.drug_name = sig.drug_name
  WHERE sig.dataset_version IS NULL OR r.report_quarter = sig.dataset_version),
sig_blocks AS (
  SELECT signal_id, age, sex, date, count(*) AS block_size, min(report_id) AS first_report
  FROM sig_members GROUP BY 1, 2, 3, 4 HAVING count(*) > 1),
sig_dup_counts AS (
  SELECT signal_id, CAST(sum(block_size * (block_size - 1) // 2) AS BIGINT) AS duplicate_count, CAST(sum(block_size - 1) AS BIGINT) AS listed
  FROM sig_blocks GROUP BY 1),
ingested AS (
  SELECT d.primaryid AS report_id, d.drug_name, r.reactions, r.ordered,
    {{ingest_age}} AS patient_age,
    CASE WHEN upper(trim(sex)) IN ('1', 'M', 'MALE') THEN 'M' WHEN upper(trim(sex)) IN ('2', 'F', 'FEMALE') THEN 'F' END AS patient_sex,
    nullif(trim(event_dt), '') AS event_date, coalesce(seriousness, 'Unknown') AS seriousness,
    coalesce(seriousness_codes, '') AS seriousness_codes, '2026Q1' AS report_quarter, 'FDA_FAERS' AS source
  FROM (SELECT primaryid, upper(trim(drugname)) AS drug_name FROM drug QUALIFY row_number() OVER
      (PARTITION BY primaryid ORDER BY role_cod <> 'PS', CAST(drug_seq AS INTEGER), drugname) = 1) d
  JOIN (SELECT primaryid, array_to_string(list(event_name ORDER BY line, first_pt), '|') AS reactions,
      list(event_name ORDER BY line, first_pt) AS ordered FROM (
      SELECT primaryid, upper(trim(pt)) AS event_name, min(l_linenumber) AS line, arg_min(pt, (l_linenumber, pt)) AS first_pt
      FROM reac GROUP BY 1, 2) GROUP BY 1) r USING (primaryid)
  LEFT JOIN demo USING (primaryid) LEFT JOIN classified_ingest USING (primaryid)),
docs AS (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, source || '.txt' AS filename,
    CASE WHEN lang = 'de' THEN 'SIG-0000000000' ELSE s.signal_id END AS signal_id, text
  FROM documents LEFT JOIN (SELECT length(drug_name) % 7 AS slot, min(signal_id) AS signal_id FROM sig GROUP BY 1) s
    ON doc_id % 7 = slot),
analyses AS (
  SELECT 'quality' || doc_id AS analysis_id, CAST(doc_id AS VARCHAR) AS document_id,
    CASE WHEN quality = 1 THEN 'completed' ELSE 'needs_review' END AS analysis_status,
    CASE WHEN quality = 0 THEN 'gap ' || doc_id END AS gap, quality + 1 AS sections, 20 * (1 + toxic) AS created FROM labels
  UNION ALL SELECT 'toxic' || doc_id, CAST(doc_id AS VARCHAR),
    CASE WHEN toxic = 1 THEN 'completed' ELSE 'needs_review' END,
    CASE WHEN toxic = 0 THEN 'gap ' || doc_id END, quality + 1, 30 * (1 + toxic) FROM labels),
doc_analysis AS (
  SELECT docs.*, analysis_id, analysis_status, gap, sections FROM docs LEFT JOIN (
    SELECT * FROM analyses QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created DESC, analysis_id DESC) = 1)
  USING (document_id))
"""


def ingest_age(age: str, code: str) -> str:
    raw = f"TRY_CAST(nullif(trim({age}), '') AS DOUBLE)"
    factor = (
        f"CASE trim({code}) WHEN '800' THEN 10.0::DOUBLE WHEN '801' THEN 1.0::DOUBLE WHEN '802' THEN 1.0::DOUBLE / 12 "
        "WHEN '803' THEN 1.0::DOUBLE / 52.18::DOUBLE WHEN '804' THEN 1.0::DOUBLE / 365.25::DOUBLE "
        "WHEN '805' THEN 1.0::DOUBLE / 8766 END"
    )
    return (
        f"CASE WHEN ({factor}) IS NULL THEN CASE WHEN {raw} > 0 AND {raw} <= 130 THEN {r2(raw)} END "
        f"WHEN {raw} * ({factor}) BETWEEN 0 AND 130 THEN {r2(f'{raw} * ({factor})')} END"
    )


CTE = CTE.replace("{ingest_age}", ingest_age("age", "age_cod"))


def over(select: str) -> str:
    """A statement over the shared expressions."""
    return f"WITH {CTE.strip()}\n{select.strip()}"
