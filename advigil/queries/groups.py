"""Filters, joins, set operations, aggregations and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advigil.functions import scores, texts
from advigil.operators import cases, clustering, contingency, enrichment, name_index, pairs, queue, reports, support
from advigil.operators import detection as det
from advigil.plans.star_schema import StarSchema
from advigil.plans.table_jobs import backfill_plan, backfill_summary as summarise_backfill, ingest_reports
from advigil.queries.shown import collector, flat, points
from advigil.sinks.records import valid_import_record as importable
from advigil.sinks.tables import known_metrics

QUERIES: dict = {}
query = collector(QUERIES)


# --- filters ------------------------------------------------------------------


@query
def filter_role(s: StarSchema) -> DataFrame:
    return pairs.filter_role(s.drug).groupBy("primaryid", "role_cod").agg(F.count(F.lit(1)).alias("rows"))


@query
def exclude_deleted_cases(s: StarSchema) -> DataFrame:
    return cases.exclude_deleted_cases(s.cases, s.deleted).select("primaryid", "caseid")


@query
def deleted_case_stats(s: StarSchema) -> DataFrame:
    return cases.deleted_case_stats(s.cases, s.deleted, apply=True)


@query
def restrict_to_cases(s: StarSchema) -> DataFrame:
    return cases.restrict_to_cases(s.outc, s.cases).groupBy("primaryid").agg(F.count(F.lit(1)).alias("rows"))


@query
def detect_threshold(s: StarSchema) -> DataFrame:
    return flat(s.metrics.filter(det.above_thresholds()).select("drug_name", "event_name", "a", "prr", "chi_square"))


@query
def queue_filters(s: StarSchema) -> DataFrame:
    found = queue.queue_filters(s.signals, drug=" b", event="supplier", min_prr=2.05, status="candidate")
    return found.select("signal_id", "drug_name", "event_name")


@query
def queue_search_ui(s: StarSchema) -> DataFrame:
    return queue.queue_search(s.signals, " Ring ", priority="low").select("signal_id", "drug_name", "event_name")


def _over_texts(texts: tuple[str, ...], search) -> DataFrame:
    """Results of several searches with their text."""
    out = None
    for text in texts:
        part = search(text).withColumn("text", F.lit(text))
        out = part if out is None else out.unionByName(part)
    return out


# Short, of a run's length, long, absent, padded, and the empty text.
TEXTS = ("b", "ri", "ing", " Small Gizm", "R#00000000", "no such name", "d w", "")


@query
def name_search(s: StarSchema) -> DataFrame:
    """Drug and event names by index, with the quarters they are reported in."""
    found = [
        _over_texts(TEXTS, lambda text, k=kind: name_index.search_names(s.name_index, text, k)).withColumn("kind", F.lit(kind))
        for kind in (name_index.DRUG, name_index.EVENT)
    ]
    later = _over_texts(TEXTS, lambda text: name_index.search_names(s.name_index, text, quarter="1998Q1")).withColumn("kind", F.lit("drug of 1998Q1"))
    return found[0].unionByName(found[1]).unionByName(later)


@query
def drug_search_by_index(s: StarSchema) -> DataFrame:
    return _over_texts(TEXTS, lambda text: name_index.indexed_drug_search(s.signals, s.name_index, text))


@query
def queue_filters_by_index(s: StarSchema) -> DataFrame:
    """All pairs whose drug and event names hold a text; names are looked up once, pairs are joined."""
    rows = s.stored_metrics.select("signal_id", "drug_name", "event_name", "a")
    drugs = name_index.with_names_like(rows, s.name_index, "drug_name", " ed g")
    return name_index.with_names_like(drugs, s.name_index, "event_name", "#00000001", name_index.EVENT)


@query
def array_contains_event(s: StarSchema) -> DataFrame:
    event = F.lit("Supplier#000000007")
    return s.reports.select(
        "report_id",
        "drug_name",
        support.mentions_event(F.col("reactions"), event).alias("exact"),
        support.mentions_event(F.transform("reactions", lambda x: F.lower(x)), event, ignore_case=True).alias("ignoring_case"),
    )


@query
def valid_import_record(s: StarSchema) -> DataFrame:
    """Signal records with faults, and whether each may be imported."""
    n = F.col("supporting_report_count") % 4
    faulty = s.candidates.select(
        "signal_id",
        "drug_name",
        F.when(n != 1, F.col("event_name")).otherwise("").alias("event_name"),
        F.when(n != 2, F.lit("candidate")).otherwise("open").alias("candidate_status"),
        F.lit(None).cast("string").alias("priority_level"),
        F.when(n != 3, F.col("prr")).otherwise(F.lit(float("nan"))).alias("prr"),
    )
    return faulty.select("signal_id", importable().alias("importable"))


@query
def usable_report(s: StarSchema) -> DataFrame:
    """Reports with both an analysed drug and a reaction."""
    return pairs.matched_reports(s.drug, s.reac, s.cases)


@query
def status_open_count(s: StarSchema) -> DataFrame:
    return queue.queue_total(s.signals).select("total", "open_signals")


# --- joins ----------------------------------------------------------------------


@query
def pair_expansion(s: StarSchema) -> DataFrame:
    return s.pairs.select("primaryid", "caseid", "drug_name", "event_name")


@query
def margins_join(s: StarSchema) -> DataFrame:
    return contingency.margins(s.pair_counts).select("drug_name", "event_name", "a", "n_drug", "n_event", "n_total")


@query
def orphan_accounting(s: StarSchema) -> DataFrame:
    return pairs.orphan_accounting(s.drug, s.reac, s.cases)


@query
def case_lookup_join(s: StarSchema) -> DataFrame:
    rows = s.pairs.select("primaryid", "drug_name").distinct()
    return flat(reports.with_case_fields(rows, s.cases))


@query
def seriousness_join(s: StarSchema) -> DataFrame:
    classes = reports.seriousness(s.outc)
    return flat(reports.with_seriousness(s.cases.select("primaryid"), classes))


def ingested(s: StarSchema) -> DataFrame:
    """Records of the whole release as the ingest builds them."""
    return ingest_reports(
        s.demo.withColumn("_pos", F.col("caseversion")),
        s.drug.withColumn("_pos", F.struct(F.col("drug_seq").cast("int"), F.col("drugname"))),
        s.reac.withColumn("_pos", F.struct("l_linenumber", "pt")),
        s.outc,
        s.QUARTER,
    )


@query
def ingest_outer_join(s: StarSchema) -> DataFrame:
    return flat(ingested(s))


@query
def enrich_join(s: StarSchema) -> DataFrame:
    """Signals with the metrics of those pairs whose PRR is above 2.1."""
    m = s.stored_metrics.filter(F.col("prr") > 2.1).select("signal_id", "chi_square", "prr_lower", "ror_lower")
    return flat(
        enrichment.enrich_signals(s.stored(s.candidates, "candidates"), m).select("signal_id", "risk_score", "priority_level")
    )


@query
def metrics_semi(s: StarSchema) -> DataFrame:
    return flat(known_metrics(s.stored_metrics, s.candidates).select("signal_id", "a", "chi_square"))


@query
def supporting_reports_join(s: StarSchema) -> DataFrame:
    found = support.supporting_reports(s.signals, s.stored_reports)
    return found.select("signal_id", "report_id", "report_quarter", "seriousness")


# --- set operations ----------------------------------------------------------------


@query
def distinct_rows(s: StarSchema) -> DataFrame:
    return pairs.suspect_drugs(s.drug, s.cases).select("primaryid", "caseid", "drug_name")


@query
def distinct_pairs(s: StarSchema) -> DataFrame:
    """Pairs with the smallest raw spelling of both names."""
    return s.pairs.select("primaryid", "drug_name", "event_name", "raw_drug_name", "raw_reaction")


@query
def union_all(s: StarSchema) -> DataFrame:
    """Reports per quarter of all signal pairs, in one grouped join."""
    rows = support.support_by_quarter(s.signals, s.stored_reports)
    return rows.groupBy("report_quarter").agg(F.sum("n").alias("reports"))


@query
def intersect_except(s: StarSchema) -> DataFrame:
    return pairs.orphan_reports(s.drug, s.reac, s.cases)


@query
def id_union(s: StarSchema) -> DataFrame:
    """Ids of the demographic or the drug table."""
    return s.demo.select("primaryid").unionByName(s.drug.select("primaryid")).distinct()


# --- aggregations --------------------------------------------------------------------


@query
def pair_counts(s: StarSchema) -> DataFrame:
    return s.pair_counts


@query
def pair_counts_by_quarter(s: StarSchema) -> DataFrame:
    return contingency.quarterly_pair_counts(s.dated_pairs)


@query
def contingency_table(s: StarSchema) -> DataFrame:
    return contingency.contingency(s.pair_counts)


@query
def reactions_per_report(s: StarSchema) -> DataFrame:
    return flat(reports.reactions_per_report(s.pairs))


@query
def reactions_in_order(s: StarSchema) -> DataFrame:
    rows = s.reac.withColumn("_pos", F.struct("l_linenumber", "pt"))
    return flat(reports.reactions_in_order(rows, "_pos"))


@query
def seriousness(s: StarSchema) -> DataFrame:
    return flat(reports.seriousness(s.outc))


@query
def seriousness_ingest(s: StarSchema) -> DataFrame:
    return flat(reports.seriousness_ingest(s.outc))


@query
def primary_drug(s: StarSchema) -> DataFrame:
    rows = s.drug.withColumn("_pos", F.struct(F.col("drug_seq").cast("int"), F.col("drugname")))
    return reports.primary_drug(rows, "_pos")


@query
def first_demo_per_report(s: StarSchema) -> DataFrame:
    """First version row of each case, taken as if cases were reports."""
    rows = s.demo.select(
        F.col("caseid").alias("primaryid"),
        "age",
        "age_cod",
        "sex",
        "event_dt",
        F.struct("caseversion", F.col("primaryid").cast("bigint")).alias("_pos"),
    )
    return reports.first_demo_per_report(rows, "_pos")


@query
def pair_stats(s: StarSchema) -> DataFrame:
    return pairs.pair_stats(s.drug, s.reac, s.cases, s.pairs)


@query
def detection_stats(s: StarSchema) -> DataFrame:
    return det.detection_stats(s.metrics)


@query
def trend_series(s: StarSchema) -> DataFrame:
    series = support.trend_series(s.signals, s.reports, counts=s.support_counts)
    return series.select("signal_id", points(F.col("trend_data")).alias("series"))


@query
def trend_slope(s: StarSchema) -> DataFrame:
    return flat(support.trend_slopes(s.signals, s.reports, scope="all", counts=s.support_counts))


@query
def trend_slope_of_users(s: StarSchema) -> DataFrame:
    """Slope of daily event counts of every user."""
    per = s.table("events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("quarter")).agg(
        F.count(F.lit(1)).cast("double").alias("count")
    )
    return flat(scores.trend_scores_by_key(per, "user_id", "quarter", "count"))


@query
def case_quality(s: StarSchema) -> DataFrame:
    quality = support.case_quality(s.signals, s.reports, counts=s.support_counts)
    shown = F.transform("indicators", lambda x: F.concat(x["description"], F.lit(" ["), x["impact_level"], F.lit("]")))
    return flat(quality.withColumn("indicators", shown))


@query
def case_quality_precedence(s: StarSchema) -> DataFrame:
    """Stored quality of closed signals wins."""
    stored = s.signals.filter("candidate_status = 'closed'").select(
        "signal_id",
        F.lit(1).cast("bigint").alias("total_reports"),
        F.lit(0).cast("bigint").alias("missing_age_count"),
        F.lit(0).cast("bigint").alias("missing_sex_count"),
        F.lit(0).cast("bigint").alias("missing_date_count"),
        F.lit(0.5).alias("quality_score"),
        F.array(F.lit("stored")).alias("quality_flags"),
        F.array().cast("array<struct<flag:string,description:string,impact_level:string>>").alias("indicators"),
    )
    quality = support.case_quality(s.signals, s.reports, stored, counts=s.support_counts)
    return flat(quality.select("signal_id", "total_reports", "quality_score", "quality_flags"))


@query
def drug_search(s: StarSchema) -> DataFrame:
    return support.drug_search(s.signals, s.stored_reports, " b")


@query
def drug_search_reports_only(s: StarSchema) -> DataFrame:
    """No signal of a closed search: the drugs of the reports are listed."""
    none = s.candidates.filter(F.col("supporting_report_count") < 0)
    return support.drug_search(none, s.reports, "bolt")


@query
def group_by_drug(s: StarSchema) -> DataFrame:
    return clustering.group_by_drug(s.candidates)


@query
def group_by_event(s: StarSchema) -> DataFrame:
    return clustering.group_by_event(s.candidates)


@query
def enrichment_summary(s: StarSchema) -> DataFrame:
    return enrichment.enrichment_summary(s.signals)


def _stored_unknown(s: StarSchema) -> DataFrame:
    """Reports as stored before outcomes were known."""
    return s.reports.withColumns(
        {"seriousness": F.lit("Unknown"), "seriousness_codes": F.array().cast("array<string>")}
    )


@query
def backfill_update_join(s: StarSchema) -> DataFrame:
    plan = backfill_plan(_stored_unknown(s), s.outc)
    return flat(plan.select("report_id", "drug_name", "seriousness", "seriousness_codes", "changed"))


@query
def backfill_summary(s: StarSchema) -> DataFrame:
    return summarise_backfill(backfill_plan(_stored_unknown(s), s.outc))


@query
def case_version_stats(s: StarSchema) -> DataFrame:
    return cases.case_version_stats(s.demo)


@query
def checklist_progress(s: StarSchema) -> DataFrame:
    """Checklist items per report, one per known field."""
    from advigil.fixed_values import CHECKLIST_ITEMS

    known = [
        F.col("patient_age").isNotNull(),
        F.col("patient_sex").isNotNull(),
        F.col("event_date").isNotNull(),
        F.col("seriousness") == "Serious",
        F.size("reactions") > 2,
        F.lit(None).cast("boolean"),
    ]
    checklist = F.struct(*[k.alias(n) for k, n in zip(known, CHECKLIST_ITEMS)])
    return s.reports.select("report_id", "drug_name", checklist.alias("c")).select(
        "report_id", "drug_name", texts.checklist_progress(F.col("c")).cast("bigint").alias("items_done")
    )


# --- windows ---------------------------------------------------------------------------


@query
def latest_case_version(s: StarSchema) -> DataFrame:
    return cases.latest_case_versions(s.demo).select("caseid", "primaryid", "caseversion")


@query
def rank_signals(s: StarSchema) -> DataFrame:
    ranked = enrichment.rank_signals(s.signals)
    return flat(ranked.select("signal_id", "dataset_version", "risk_score", "rank"))


@query
def rank_pairs(s: StarSchema) -> DataFrame:
    """Every pair ranked within its drug by PRR, as the ranking treats releases."""
    rows = s.stored_metrics.select(
        "signal_id",
        "drug_name",
        "event_name",
        F.col("a").alias("supporting_report_count"),
        F.round("prr", 6).alias("risk_score"),
        F.lit(None).cast("double").alias("trend_score"),
        F.col("drug_name").alias("dataset_version"),
    )
    return enrichment.rank_signals(rows).select(
        "signal_id", "dataset_version", F.col("rank").cast("bigint").alias("rank")
    )


@query
def margins(s: StarSchema) -> DataFrame:
    """Drug and event margins on their own."""
    m = contingency.margins(s.pair_counts)
    drug = m.groupBy(F.lit("drug").alias("side"), F.col("drug_name").alias("name")).agg(
        F.max("n_drug").alias("reports"), F.sum("a").alias("sum_of_cells")
    )
    event = m.groupBy(F.lit("event").alias("side"), F.col("event_name").alias("name")).agg(
        F.max("n_event").alias("reports"), F.sum("a").alias("sum_of_cells")
    )
    return drug.unionByName(event)


@query
def latest_per_key(s: StarSchema) -> DataFrame:
    """Latest turn of every conversation."""
    from advigil.operators.documents import latest_per_key as latest

    turns = s.table("conversations").select(
        "conv_id", F.timestamp_seconds("turn").alias("created_at"), "turn", "role", "text"
    )
    return latest(turns, "conv_id").select("conv_id", "turn", "role", "text")
